"""Small tables with the awkward rows that every operator must survive."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

PROSE = "The old ferry left the harbour before dawn, and nobody on the quay waved. It carried letters, tin and two sleeping dogs across the grey strait."

TEXTS = [
    None,
    "",
    " ",
    "\n\n\t \r\n",
    PROSE,
    PROSE,
    PROSE + " Then it rained.",
    "a  b   c\n\nd\te \n f",
    "▁a▁▁b ▁ c▁",
    "naïve café 😀 — 日本語テキスト  x y　z\x85q",
    "\x00\x01 ctrl \x1c\x1d\x1e\x1f end \x0b\x0c vt",
    "<|endoftext|> stays <|endoftext|>  <|endoftext|>x <s> </s> <unk> <0x0A>",
    "don't can't I'm you're  they'll 's 've",
    "x" * 5000,
    "word " * 3000,
    "🏴󠁧󠁢󠁥󠁮󠁧󠁿 é ​ zero‍width ﻿ bom",
    "12345 67.89 $$$ ### %%% | a | b |",
]


def documents(spark, texts=TEXTS, extra=()):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], DOCUMENTS)


def dump(spark, tmp_path, df, name="documents"):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
