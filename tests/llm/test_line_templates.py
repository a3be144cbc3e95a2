import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.llm import line_templates as L


def mask(line):
    return " ".join("<*>" if re.search("[0-9]", t) else t for t in re.split("[ \t\r\x0b\x0c]+", line) if t)


def slow(rows, min_docs=3, leading=3, similarity=0.8):
    """(key, place) of the lines to drop, one leaf at a time."""
    leaves = defaultdict(list)
    for key, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            tokens = mask(line).split()
            if tokens:
                leaves[len(tokens), tuple(tokens[:leading])].append((key, pos, tuple(tokens)))
    drop = set()

    def decide(members):
        keys = {k for k, _, _ in members}
        if len(keys) >= min_docs:
            first = min((k for k in keys if k is not None), default=None)
            drop.update((k, p) for k, p, _ in members if k != first)

    for lines in leaves.values():
        by_line = defaultdict(list)
        for line in lines:
            by_line[line[2]].append(line)
        for members in by_line.values():
            decide(members)
        keys = [k for k, _, _ in lines if k is not None]
        if len(by_line) > 1 and keys and min(keys) < max(keys):
            n = len(lines[0][2])
            common = []
            for place in range(n):
                votes = Counter(t[place] for _, _, t in lines)
                common.append(min(votes, key=lambda t: (-votes[t], t)))
            behind = max(0, n - leading)
            need = -int(-behind * similarity // 1)
            decide([x for x in lines if sum(a == b for a, b in zip(x[2][leading:], common[leading:])) >= need])
    return drop


def dropped(docs, **options):
    return {(r.key, r.pos) for r in L.repeated_lines(docs, **options).collect()}


ROWS = [
    (1, "Page 1 of 10\nfirst document\nShare this page with your friends on Alpha today"),
    (2, "Page 2 of 10\nsecond document\nShare this page with your friends on Beta today"),
    (3, "Page 31 of 7\n\nShare this page with your friends on Gamma today\nsecond document"),
    (4, "only here\n  Page\t4 of  9  \nShare this page with nothing in common but length"),
    (5, None),
    (6, ""),
    (7, "same\nsame\nsame"),
    (8, "same\nbut one"),
    (None, "same\nPage 5 of 5"),
    (9, "all new words in this line here\nsame"),
    (9, "all new words in this line here\nsame"),
]


def test_templates(frame):
    found = dropped(frame(ROWS))
    assert found == slow(ROWS)
    assert {(2, 0), (3, 0), (4, 1), (None, 1)} <= found and (1, 0) not in found
    assert {(2, 2), (3, 2)} <= found and (1, 2) not in found and (4, 2) not in found
    assert (3, 3) not in found  # in two documents only
    assert (7, 0) not in found and (8, 0) in found


def test_many_lines(frame, prose):
    import random

    rng = random.Random(3)
    base = [prose(i, rng.randint(1, 14)) for i in range(40)]
    rows = []
    for key in range(60):
        lines = []
        for _ in range(12):
            words = rng.choice(base).split()
            if rng.random() < 0.5 and len(words) > 4:
                words[rng.randrange(3, len(words))] = rng.choice(["other", str(rng.randint(1, 99)), "word"])
            lines.append(" ".join(words))
        rows.append((key, "\n".join(lines)))
    assert dropped(frame(rows)) == slow(rows)
    assert dropped(frame(rows), min_docs=20, similarity=0.6, leading=2) == slow(rows, 20, 2, 0.6)


def test_texts_without_them(spark):
    rows = [(k, t, k, "x") for k, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pos bigint, line string")
    out = L.without_repeated_lines(docs)
    assert out.columns == [*docs.columns, "__lines", "__dropped"]
    drop = slow(ROWS)
    expected = []
    for key, text in ROWS:
        lines = None if text is None else text.split("\n")
        kept = None if text is None else "\n".join(x for i, x in enumerate(lines) if (key, i) not in drop)
        expected.append((key, kept, len(lines or []), sum((key, i) in drop for i in range(len(lines or [])))))
    got = [(r.doc_id, r.text, r["__lines"], r["__dropped"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_no_python_in_the_plan(frame):
    df = L.without_repeated_lines(frame(ROWS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("line", ["", " ", "a", "a 1b c", "\t x  y z ", "2024-01-01 x", "é1 ß", "1"])
def test_mask(spark, line):
    assert spark.range(1).select(L.masked(F.lit(line)).alias("m")).first().m == mask(line)


def test_long_line(frame):
    rows = [(i, "word " * 20_000 + str(i)) for i in range(4)]
    assert dropped(frame(rows)) == {(1, 0), (2, 0), (3, 0)}


def test_empty(frame):
    assert L.without_repeated_lines(frame([])).count() == 0


@pytest.mark.parametrize("key", [5, None])
def test_texts_under_one_key(frame, key):
    """A row loses its own recurring lines, not the places at which other rows of its key have them."""
    rows = [(1, "common line"), (2, "common line"), (3, "x\ncommon line"), (key, "common line\nalpha"), (key, "beta\ngamma")]
    rows += [(key, "delta\nepsilon\ncommon line"), (key, "delta\nepsilon\ncommon line")]
    out = L.without_repeated_lines(frame(rows))
    got = sorted((r.text, r["__dropped"]) for r in out.where(F.col("doc_id").eqNullSafe(F.lit(key))).collect())
    assert got == [("alpha", 1), ("beta\ngamma", 0), ("delta\nepsilon", 1), ("delta\nepsilon", 1)]


def test_templates_that_share_a_leaf(frame, prose):
    """Two interleaved templates with a word as their field, a rare third one, and unrelated lines between."""
    names = "ada ben cleo dan eva finn gus hana ivo jill kim leo".split()
    rows = []
    for i, name in enumerate(names):
        a = f"posted in the {name} category by our editors every single day"
        b = f"posted in the morning hours for {name} readers of local news"
        c = f"posted in the hope that {name} subscribers come back quite soon"
        # Shares all but a run of three places with ``b``.
        d = f"posted in the late summer while {name} readers of local news"
        rows.append((i, "\n".join([a, b, *[c] * (i < 3), *[d] * (i < 5), f"posted in the {prose(i, 8)}", f"own {i}x"])))
    found = dropped(frame(rows))
    expected = set()
    for i in range(1, len(names)):
        expected |= {(i, 0), (i, 1), *[(i, 2)] * (i < 3), *[(i, 3 - (i >= 3))] * (i < 5)}
    last = {(i, text.count("\n")) for i, text in rows}
    assert {x for x in found if x not in last} == expected


def test_long_lines_of_two_documents(frame, prose):
    """A passage recurs from two documents on, the smaller key keeps it; a short line does not."""
    passage, other = prose(1, 60), prose(2, 60)
    changed = other.split()
    changed[30] = "changed"
    rows = [(1, f"{passage}\nshort line\n{other}"), (2, f"own\n{passage}"), (3, f"short line\n{' '.join(changed)}")]
    assert dropped(frame(rows)) == {(2, 1), (3, 1)}
    assert dropped(frame(rows), min_docs=3) == set()
