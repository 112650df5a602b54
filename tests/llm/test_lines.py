import random

import pytest

from quern.llm import lines as L


def shingles(line, k=4):
    return {line[i : i + k] for i in range(len(line) - k + 1)} if len(line) >= k else {line}


def brute(docs, t=0.8):
    seen = {}
    for key, (i, text) in enumerate(docs):
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            if line.strip(" "):
                seen.setdefault(line.strip(" "), []).append((i, pos))
    names = sorted(seen)
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {x: shingles(x) for x in names}
    for a in names:
        for b in names:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= t:
                parent[find(a)] = find(b)
    first = {}
    for x in names:
        first[find(x)] = min([first.get(find(x), (1e30, 0)), *seen[x]])
    out = {}
    for i, text in docs:
        pieces = text.split("\n") if text is not None else []
        kept = [p for k, p in enumerate(pieces) if not p.strip(" ") or first[find(p.strip(" "))] == (i, k)]
        out[i] = (sum(bool(p.strip(" ")) for p in pieces), sum(bool(p.strip(" ")) for p in kept), "\n".join(kept) if text is not None else None)
    return out


def test_brute_force(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    base = [" ".join(word() for _ in range(rng.randrange(1, 45))) for _ in range(60)]
    docs = []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(0, 9)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = "X"
            text.append("".join(line) + rng.choice(["", "", " ", "!"]))
            text += [""] * rng.choice([0, 0, 1])
        docs.append((i, "\n".join(text)))
    docs += [(200, None), (201, ""), (202, "\n \n"), (203, base[0]), (204, base[0] + "\n" + base[0])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_lines string")
    want = brute(docs)
    lost = sum(n - k for n, k, _ in want.values())
    for options in ({}, {"bands": 60}):
        got = {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in L.dedup(df, **options).collect()}
        # Every removed line is near a line that stays, and hardly any near line is missed.
        assert all(got[i][0] == want[i][0] and got[i][1] >= want[i][1] for i in want)
        assert all(got[i] == want[i] for i in want if got[i][1] == want[i][1])
        assert sum(got[i][1] - want[i][1] for i in want) <= 0.03 * lost
    assert got == want  # nothing is missed where the banding is all but certain
    left = L.without_repeats(df, **options)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {i for i in got if want[i][1] or not got[i][0]}


def test_rows_with_one_id_and_empty(spark):
    df = spark.createDataFrame([(1, "a line of text"), (1, "a line of text"), (1, "other words here"), (None, "a line of text"), (2, "A line of text")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_kept, r.text) for r in L.dedup(df).collect())
    assert got == [("1", 1, "a line of text"), ("1", 1, "a line of text"), ("1", 1, "other words here"), ("2", 0, ""), ("None", 0, "")]
    assert L.report(df.limit(0)).count() == 0 and L.without_repeats(df.limit(0)).columns == df.columns


def test_unlike_lines_in_one_bucket(spark):
    """Near lines in pairs; all lines open alike, so they share buckets, but the pairs are unlike."""
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    opening, docs = say(40), []
    for k in range(50):
        line = f"{opening} {say(25)}"
        docs += [(2 * k, line), (2 * k + 1, line + f" {k}.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in L.without_repeats(df).collect()} == {2 * k for k in range(50)}


@pytest.mark.parametrize("blanks", [True, False])
def test_one_edit(spark, blanks):
    """Copies of lines of 40 to 110 characters with one character changed, with and without blanks."""
    rng = random.Random(7)
    docs = []
    for k in range(300):
        line = [rng.choice("abcdefghiklmnoprstuäé" + "    " * blanks) for _ in range(rng.randrange(42, 110))]
        line[0] = line[-1] = "x"
        other = list(line)
        other[rng.randrange(4, len(line) - 4)] = "Q"
        docs += [(2 * k, "".join(line)), (2 * k + 1, "".join(other))]
    got = {r.doc_id for r in L.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {2 * k for k in range(300)} <= got and len(got) - 300 <= 9


@pytest.mark.parametrize("shape", ["short words", "long words", "no blanks", "ideographs"])
def test_recall_at_the_threshold(spark, shape):
    """Of pairs of long lines whose similarity is just over 0.8 by scattered edits, 9 of 10 are found."""
    rng = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(3000)] if shape == "ideographs" else list("abcdefghijklmnopqrstuvwxyz")
    docs, pairs = [], 0
    while pairs < 200:
        n = rng.choice([90, 115, 180, 300, 360, 500, 1200])
        line = [rng.choice(letters) for _ in range(n)]
        at = 0
        while shape.endswith("words") and (at := at + rng.randrange(3, 9 if shape == "short words" else 30)) < n - 1:
            line[at] = " "
        other = list(line)
        while True:
            last, place = "".join(other), rng.randrange(1, n - 1)
            other[place] = "Q"
            a, b = shingles("".join(line)), shingles("".join(other))
            if len(a & b) / len(a | b) < 0.8:
                break
        docs += [(2 * pairs, "".join(line)), (2 * pairs + 1, last)]
        pairs += 1
    got = {r.doc_id for r in L.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {2 * k for k in range(pairs)} <= got and len(got) - pairs <= 0.1 * pairs, len(got) - pairs


def test_separators_and_a_very_long_line(spark):
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(30000))
    df = spark.createDataFrame([(1, "-----"), (2, "----------"), (3, "=" * 90), (4, "=" * 110), (5, long), (6, long + " end"), (7, long[:200])], "doc_id long, text string")
    assert {r.doc_id for r in L.without_repeats(df).collect()} == {1, 3, 5, 7}


def test_sets_and_similarity():
    rng = random.Random(2)
    lines = ["".join(rng.choice("abü漢𝄞") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    x, y = lines[:30], lines[30:]
    x, y = x + lines, y + lines
    of = lambda s: {s[i : i + 4] for i in range(len(s) - 3)} or {s}
    for t in (0.1, 0.5, 1.0):
        want = [len(of(a) & of(b)) / len(of(a) | of(b)) >= t for a, b in zip(x, y, strict=True)]
        assert L.similar_lines(x, y, t) == want
    assert L.bags(lines)[0].tolist() == [len(of(s)) for s in lines]


def test_null_ids_and_a_hot_line(spark):
    """A line that all documents have, and rows without an id; nothing but the repeats goes."""
    rows = [(None if i % 3 == 0 else i, f"the same line of every document\nown line number {i} of document {i * i}", {"n_kept": str(i)}) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _quern struct<n_kept string>")
    got = L.without_repeats(df)
    assert got.columns == df.columns and got.count() == 300
    texts = [r.text for r in got.collect()]
    assert sum("same line" in t for t in texts) == 1 and all("own line" in t for t in texts)


def test_no_python_on_the_executors(spark, monkeypatch):
    """DataFrame operations only; a run of one character meets a longer one whose level of lengths is another."""
    from pyspark.sql import DataFrame, GroupedData
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    def fail(*args, **kwargs):
        raise AssertionError("Python on the executors")

    for kind, names in ((DataFrame, ("mapInArrow", "mapInPandas")), (GroupedData, ("applyInArrow", "applyInPandas")), (PandasCogroupedOps, ("applyInArrow", "applyInPandas"))):
        for name in names:
            monkeypatch.setattr(kind, name, fail)
    df = spark.createDataFrame([(1, "=" * 90), (2, "=" * 900), (3, "one line\nanother line")], "doc_id long, text string")
    assert {r.doc_id: r.n_kept for r in L.dedup(df).collect()} == {1: 1, 2: 0, 3: 2}
