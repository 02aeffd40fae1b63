import random

import pandas as pd
import pytest

from gazeloom.llm import quality

NOUNS = "lamp river stone garden window teacher bottle engine harvest mirror".split()
PROSE = (
    "When the {0} is near the {1}, nobody can tell which of them was there before.", "It is better to keep a {0} than to look for a new {1} every year.",
    "We were told that the {0} had been moved to the other side of the {1}.", "Most of the people who saw the {0} did not think about the {1} at all.",
    "Der {0} ist nicht so alt wie das Haus, in dem auch die Frau mit dem {1} lebt.", "La gente que vive cerca del {0} no sabe que el {1} es de su padre.",
)


def prose(rng, wrap):
    text = " ".join(rng.choice(PROSE).format(*rng.sample(NOUNS, 2)) for _ in range(rng.randrange(8, 25)))
    if wrap:
        lines, line = [], ""
        for word in text.split():
            if len(line) + len(word) > wrap:
                lines.append(line)
                line = ""
            line += word + " "
        text = "\n".join([*lines, line])
    return f"# {rng.choice(NOUNS)}\n\n{text}\n"


def code(rng):
    body = "\n".join(f"    {a}_{b} = {a}.get({b}[{rng.randrange(9)}], {{'{b}': None}})\n    # keep the {a} that was there before" for a, b in (rng.sample(NOUNS, 2) for _ in range(rng.randrange(4, 15))))
    return f"# It is the part of the program that we use for the {rng.choice(NOUNS)}.\ndef {rng.choice(NOUNS)}(x):\n{body}\n"


def others(rng):
    return {
        "list": "\n".join(f"- {rng.choice(NOUNS)} {rng.choice(NOUNS)}" for _ in range(20)),
        "table": "\n".join(",".join([rng.choice(NOUNS), *[f"{rng.random() * 99:.2f}" for _ in range(5)]]) for _ in range(20)),
        "junk": " ".join(" ".join(rng.choices(NOUNS, k=7)).capitalize() + "." for _ in range(20)),
        "repetition": (rng.choice(PROSE).format(*rng.sample(NOUNS, 2)) + " ") * 30,
    }


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = []
    for _ in range(120):
        rows.append(("prose", prose(rng, rng.choice((0, 30, 72)))))
        rows.append(("code", code(rng)))
        rows += others(rng).items()
    return pd.DataFrame(rows, columns=["truth", "text"]).assign(doc_id=lambda d: range(len(d)), kind="clash", n_words="clash")


def test_held_out_accuracy(spark, corpus):
    model = quality.fitted_model(spark.createDataFrame(corpus[:360]), "doc_id", "text")
    got = quality.quality_statistics(spark.createDataFrame(corpus[360:]), "doc_id", "text", model).toPandas().merge(corpus[["doc_id", "truth"]], on="doc_id")
    assert len(got) == 360
    prose_like = got["truth"] == "prose"
    assert (got.loc[prose_like, "kind"] == "prose").mean() > 0.97 and (got.loc[~prose_like, "kind"] == "prose").mean() < 0.01
    assert (got.loc[got["truth"] != "junk", "kind"] == got.loc[got["truth"] != "junk", "truth"]).mean() > 0.9


def test_statistics(spark):
    text = "The cat sat on it.\n\n- two words\r\nlast line, 12!"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (None, " \n\t"), (4, "x" * 300_000), (4, "..."), (1, text)], "id int, text string")
    rows = quality.quality_statistics(df, "id", "text").collect()
    assert len(rows) == 7
    one = [r for r in rows if r.id == 1]
    assert one[0] == one[1] and one[0].n_words == 9 and abs(one[0].mean_word_length - 29 / 9) < 1e-9
    assert abs(one[0].punctuated_line_share - 2 / 3) < 1e-9 and abs(one[0].common_word_share - 3 / 9) < 1e-9
    assert abs(sum(one[0][f"{n}_share"] for n in quality.LABELS) - 1) < 1e-9
    assert {r.kind for r in rows if r.id in (2, 3, None)} == {"empty"}
    assert [r.n_words for r in rows if r.id == 4] == [1, 0]


def test_empty_table(spark):
    assert quality.quality_statistics(spark.createDataFrame([], "id int, text string"), "id", "text").count() == 0


def test_repetition_does_not_depend_on_length():
    rng = random.Random(2)
    sentences = [rng.choice(PROSE).format(*rng.sample(NOUNS, 2)) + f" It was the {''.join(rng.choices('abcdefgh', k=6))}." for _ in range(4000)]
    lines = quality.line_statistics([" ".join(sentences).encode(), (sentences[0] * 500).encode(), b"one two"])
    shingles = quality.shingle_hashes(lines, pd.RangeIndex(3).to_numpy())
    long, again, short = quality.distinct_shares(*shingles)
    assert long > 0.6 and again < 0.2 and short == 1
    assert quality.periodic_shares(*shingles).tolist()[2] == 0 and quality.periodic_shares(*shingles)[1] > 0.9


@pytest.mark.parametrize("words", [60, 150, 300, 1200])
def test_a_long_passage_repeated_is_repetition(words):
    rng = random.Random(words)
    make = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    passage = make(words)
    lines = quality.line_statistics([(passage + "\n").encode() * 6, make(words * 6).encode(), f"{passage}\n{make(words * 2)}\n{passage}".encode()])
    again, once, quoted = quality.periodic_shares(*quality.shingle_hashes(lines, pd.RangeIndex(3).to_numpy()))
    assert again > quality.PERIODIC_SHARE > max(once, quoted)


def test_paths_are_the_most_likely(spark):
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    k = len(quality.LABELS)
    model = quality.Model(np.log(rng.dirichlet(np.ones(k))), np.log(rng.dirichlet(np.ones(k), k)), [np.log(rng.dirichlet(np.ones(n), k).T) for n in quality.SIZES])
    texts = [b"a b c\n\n- one\n12, 13", b"", b"The end is near.", b"x = {}\n# it is the one\n1 2 3\n* a"]
    lines = quality.line_statistics(texts)
    got = model.label(lines)
    score = model.score(lines.features.astype(int))
    for t in set(lines.text):
        rows = np.flatnonzero(lines.text == t)
        best = max(itertools.product(range(k), repeat=len(rows)), key=lambda p: model.start[p[0]] + sum(score[r, s] for r, s in zip(rows, p)) + sum(model.step[a, b] for a, b in zip(p, p[1:])))
        assert tuple(got[rows]) == best
