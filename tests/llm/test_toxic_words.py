import random

from tidemark.llm import toxicity


def test_one_strong_word_is_enough():
    """Words that occur together in the training texts count as much where one stands alone."""
    rnd = random.Random(8)
    plain, bad = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)], ["glorp", "snarf", "vexil", "moron", "scum"]
    sample = []
    for k in range(1200):
        own = rnd.choices(plain, k=20)
        if k % 4 == 0:
            for w in rnd.sample(bad, 4):
                own.insert(rnd.randrange(len(own) + 1), w)
        sample.append((toxicity.read(" ".join(own)), int(k % 4 == 0)))
    model = toxicity.Model(sample, 0.1)
    assert all(model.score(f"{' '.join(rnd.choices(plain, k=20))} {w}") >= 0.5 for w in bad)
    assert all(model.score(" ".join(rnd.choices(plain, k=20))) < 0.5 for _ in range(50))


def inflected(rnd, stem, n, plain):
    """Texts with two or three words of a stem, each with an ending of its own."""
    ends = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    return [" ".join([*rnd.choices(plain, k=10), *(stem + e for e in rnd.sample(ends, rnd.choice((2, 3)))), *rnd.choices(plain, k=10)]) for _ in range(n)]


def test_words_too_rare_by_themselves_share_a_stem():
    """A dozen toxic texts of forms that hardly repeat; the forms of the texts to score occur in none of them."""
    rnd = random.Random(4)
    plain = [f"{a}{b}{c}" for a in "vwxz" for b in "aeiou" for c in "lmnrst"]
    toxic = inflected(rnd, "grolf", 12, plain)
    clean = [" ".join(rnd.choices(plain, k=20)) for _ in range(80)] + inflected(rnd, "herbo", 20, plain)
    model = toxicity.Model([(toxicity.read(t), 1) for t in toxic] + [(toxicity.read(t), 0) for t in clean], 0.1)
    assert model.stems.stems == {"grolf"}
    assert all(model.score(f"val {a} wen {b}") >= 0.5 for a, b in (("grolfisch", "grolfung"), ("GROLFER", "grolfix")))
    assert all(model.score(t) < 0.5 for t in [*clean, "herboisch val herboung", "val wen xin", ""])


def test_familiar_words_do_not_hit_a_stem():
    rnd = random.Random(5)
    plain = [f"{a}{b}{c}" for a in "vwxz" for b in "aeiou" for c in "lmnrst"]
    toxic = inflected(rnd, "grolf", 30, plain)
    clean = [" ".join([*rnd.choices(plain, k=20), *rnd.sample(["grolfquo", "grolfqua"], k % 3)]) for k in range(120)]
    sample = [(toxicity.read(t), 1) for t in toxic] + [(toxicity.read(t), 0) for t in clean]
    model = toxicity.Model(sample, 0.1)
    assert model.stems.stems == {"grolf"} and model.stems.familiar == {"grolfquo", "grolfqua"}
    assert model.score("val grolfquo grolfqua wen") < 0.5 <= model.score("val grolfisch grolfung wen")


def test_stems_need_more_than_chance_and_copies():
    rnd = random.Random(6)
    plain = [f"{a}{b}{c}{d}" for a in "vwxz" for b in "aeiou" for c in "lmnrst" for d in ("", "a", "ek", "ol", "un")]
    texts = [" ".join(rnd.choices(plain, k=30)) for _ in range(400)]
    assert not toxicity.Stems([(toxicity.read(t), int(k % 9 == 0)) for k, t in enumerate(texts)], 0.1).stems
    copies = [(toxicity.read("val grolfisch grolfung wen"), 1)] * 40
    assert not toxicity.Stems(copies + [(toxicity.read(t), 0) for t in texts], 0.1).stems
