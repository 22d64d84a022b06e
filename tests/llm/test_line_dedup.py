import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from rosterlens.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute(pairs, threshold, least):
    """Dropped line numbers of each row, by comparing all lines with all; ids are unique."""
    places = [(i, n, line) for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)) for n, line in enumerate((t or "").split("\n")) if len(line) >= least]
    distinct = list(dict.fromkeys(p[2] for p in places))
    root = {line: line for line in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold:
                root[find(a)] = find(b)
    seen, out = set(), {i: [] for i, _ in pairs}
    for i, n, line in places:
        if find(line) in seen:
            out[i].append(n)
        seen.add(find(line))
    return out


def edited(line, n, rng):
    for _ in range(n):
        i = rng.randrange(len(line))
        line = rng.choice([line[:i] + line[i + 1 :], line[:i] + rng.choice("abñ🙂x ") + line[i:], line[:i] + rng.choice("qé") + line[i + 1 :]])
    return line


def texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abc de") for _ in range(rng.choice([12, 13, 30, 31, 90]))) for _ in range(12)]
    out = []
    for d in range(30):
        lines = [edited(rng.choice(base), rng.choice([0, 0, 1, 2, 3]), rng) for _ in range(rng.randrange(1, 5))]
        out.append((d, "\n".join(lines)))
    return out


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_same_as_brute_force(make, threshold):
    pairs = texts(threshold)
    got = {r.id: list(r.dropped) for r in ld.line_report(make(pairs), threshold=threshold, least_chars=12).collect()}
    expected = brute(pairs, threshold, 12)
    assert sum(map(len, expected.values())) > 20
    assert got == expected


@pytest.mark.parametrize("bucket", [1, 2, 5])
def test_split_buckets_lose_nothing(make, monkeypatch, bucket):
    """Keys split again and again, down to lines that differ in one character."""
    monkeypatch.setattr(ld, "BUCKET", bucket)
    rng = random.Random(bucket)
    base = ["abcd" * 4, "number 000000 was sent", "x" * 14]
    pairs = texts(7) + [(100 + d, "\n".join(edited(rng.choice(base), rng.choice([0, 1, 1, 2]), rng) for _ in range(4))) for d in range(40)]
    got = {r.id: list(r.dropped) for r in ld.line_report(make(pairs), threshold=1, least_chars=12).collect()}
    assert got == brute(pairs, 1, 12)


def test_numbered_lines_give_few_candidates(spark):
    """All pairs of a template would be 200 million; those one edit apart are linked, by a few candidates each."""
    lines = spark.range(20_000).select(F.format_string("Order number %06d was sent to the customer", "id").alias("line"))
    lines = lines.select(F.xxhash64("line").alias("node"), "line")
    counted = lines.select("node", F.col("line").alias("rest"), ld.letter_counts(F.col("line")).alias("letters"))
    candidates = ld.one_edit_candidates(counted, ld.CHARACTERS)
    assert candidates.count() < 60 * 20_000  # of 199,990,000 pairs
    linked = ld.components(ld.near_links(lines, 1))
    assert linked.select("component").distinct().count() == 1 and linked.count() == 20_000


def test_numbered_lines_by_words(spark):
    lines = spark.range(5_000).select(F.format_string("this is the order with number %06d that was sent to you on monday", "id").alias("line"))
    lines = lines.select(F.xxhash64("line").alias("node"), "line")
    links = ld.word_links(lines, 12)
    assert links.count() < 10 * 5_000
    assert ld.components(links).select("component").distinct().count() == 1


@pytest.mark.parametrize("bucket", [1, 256])
def test_words_one_edit_apart(make, monkeypatch, bucket):
    monkeypatch.setattr(ld, "BUCKET", bucket)
    rng = random.Random(bucket)
    words = ["a", "of", "the", "plain", "ñandú", "🙂", ""]
    base = [[rng.choice(words) for _ in range(n)] for n in (8, 9, 13, 30)] + [["same"] * 10]
    pairs = []
    for d in range(60):
        lines = []
        for _ in range(3):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                i = rng.randrange(len(line))
                line = rng.choice([line[:i] + line[i + 1 :], line[:i] + [rng.choice(words)] + line[i:], line[:i] + ["other"] + line[i + 1 :]])
            lines.append(" ".join(line))
        pairs.append((d, "\n".join(lines)))
    places = [(i, n, line) for i, t in pairs for n, line in enumerate(t.split("\n")) if len(line) >= 12]
    distinct = list(dict.fromkeys(p[2] for p in places))
    root = {line: line for line in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            x, y = a.split(" "), b.split(" ")
            if distance(a, b) <= 1 or (min(len(x), len(y)) >= 8 and distance(x, y) <= 1):
                root[find(a)] = find(b)
    seen, expected = set(), {i: [] for i, _ in pairs}
    for i, n, line in places:
        if find(line) in seen:
            expected[i].append(n)
        seen.add(find(line))
    got = {r.id: list(r.dropped) for r in ld.line_report(make(pairs), least_chars=12, edit_words=8).collect()}
    assert got == expected


def test_columns_of_any_name(spark):
    row = (1, "a line that is long enough to count\na line that is long enough to count!", 1, 2, 3, 4, 5, 6)
    names = ["doc_id", "text", "id", "__version", "dropped", "row", "key", "a.b"]
    out = ld.without_repeated_lines(spark.createDataFrame([row], names))
    assert out.columns == names
    assert tuple(out.first()) == (1, "a line that is long enough to count", 1, 2, 3, 4, 5, 6)


def test_edit_distance_within_the_band(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(250):
        a = "".join(rng.choice("ab🙂") for _ in range(rng.randrange(6, 40)))
        b = edited(a, rng.randrange(5), rng)
        rows += [(a, b, t, distance(a, b)) for t in (1, 2, 3) if abs(len(a) - len(b)) <= t]
    for a, b in (("", "a"), ("a", ""), ("a", "b"), ("ab", "ba"), ("abc", "c"), ("", "")):
        rows += [(a, b, t, distance(a, b)) for t in (1, 2, 3) if abs(len(a) - len(b)) <= t]
    df = spark.createDataFrame(rows, "a string, b string, t int, d int")
    found = df.withColumn("got", F.when(F.col("t") == 1, ld.edit_distance(F.col("a"), F.col("b"), 1))
                          .when(F.col("t") == 2, ld.edit_distance(F.col("a"), F.col("b"), 2))
                          .otherwise(ld.edit_distance(F.col("a"), F.col("b"), 3)))
    cut = ld.trimmed(df.withColumns({"x": F.col("a"), "y": F.col("b")}), "x", "y").collect()
    for r in cut:
        assert distance(r.x, r.y) == r.d and (not (r.x and r.y) or (r.x[0] != r.y[0] and r.x[-1] != r.y[-1]))
    wrong = [r for r in found.collect() if (r.got if r.got <= r.t else 99) != (r.d if r.d <= r.t else 99)]
    assert not wrong


def test_odd_rows(odd, odd_pairs, none, make):
    report = ld.line_report(odd)
    assert report.count() == len(odd_pairs)
    got = {(r.id, r.n_lines): list(r.dropped) for r in report.collect() if r.id in (5, 6, 2)}
    assert got == {(5, 1): [], (6, 1): [0], (2, 1): []}
    assert ld.line_report(none).count() == 0
    assert ld.without_repeated_lines(odd).schema.names == odd.schema.names
    assert ld.without_repeated_lines(none).count() == 0
    with pytest.raises(ValueError):
        ld.line_report(odd, threshold=3, least_chars=7)


def test_texts_without_dropped_lines(make):
    long = "a line that is long enough to count"
    docs = make([(1, f"first\n{long}"), (2, f"{long}!\nown\n{long}"), (3, None), (4, long), (5, "of\nof")])
    got = {r.doc_id: r.text for r in ld.without_repeated_lines(docs).collect()}
    assert got == {1: f"first\n{long}", 2: "own", 3: None, 4: "", 5: "of\nof"}
    near = {r.id: r.n_near for r in ld.line_report(docs).collect()}
    assert near == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}


def test_no_python_in_the_plan(spark, capsys):
    docs = spark.range(9).selectExpr("id AS doc_id", "concat('a line that is long enough ', id) AS text")
    ld.line_report(docs).explain("formatted")
    rows = docs.select(F.xxhash64("text").alias("node"), F.col("text").alias("line"))
    ld.near_links(rows, 1).explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def by_length(classes, n):
    return max((t for start, t in classes if n >= start), default=0)


@pytest.mark.parametrize("classes", [((12, 1), (20, 2), (40, 4), (90, 8)), ((12, 3), (60, 12))])
def test_thresholds_that_grow_with_length(make, classes):
    rng = random.Random(len(classes))
    words = ["a", "of", "the", "plain", "ñandú", "🙂", "wordier", "x1"]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (4, 5, 9, 12, 25, 40)] + ["abcde" * 12, "z" * 100]
    pairs = [
        (d, "\n".join(edited(rng.choice(base), rng.choice([0, 1, 2, 3, 4, 6, 8, 9, 12, 14]), rng) for _ in range(rng.randrange(1, 5))))
        for d in range(40)
    ]
    places = [(i, n, line) for i, t in pairs for n, line in enumerate(t.split("\n")) if len(line) >= 12]
    distinct = list(dict.fromkeys(p[2] for p in places))
    root = {line: line for line in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if distance(a, b) <= by_length(classes, min(len(a), len(b))):
                root[find(a)] = find(b)
    seen, expected = set(), {i: [] for i, _ in pairs}
    for i, n, line in places:
        if find(line) in seen:
            expected[i].append(n)
        seen.add(find(line))
    got = {r.id: list(r.dropped) for r in ld.line_report(make(pairs), threshold=classes, least_chars=12).collect()}
    assert sum(map(len, expected.values())) > 20
    assert got == expected


def test_a_replaced_word_in_a_passage_goes(spark, make):
    text = " ".join(f"word{i} of a passage" for i in range(15))
    docs = make([(1, text), (2, text.replace("word7 ", "something ")), (3, "short lines may differ by one edit")])
    cut = {n: {r.doc_id: r.text for r in stage(spark, docs, "").collect()} for n, stage in cp.STAGES if n == "line_dedup"}
    assert cut["line_dedup"] == {1: text, 2: "", 3: "short lines may differ by one edit"}


def test_short_lines_that_are_repeated_as_they_are(spark, make):
    docs = make([(1, "All rights reserved.\nhome"), (2, "All rights reserved.\nhome\nAll rights reserved!"), (3, "own")])
    stage = dict(cp.STAGES)["line_dedup"]
    got = {r.doc_id: r.text for r in stage(spark, docs, "").collect()}
    assert got == {1: "All rights reserved.\nhome", 2: "home\nAll rights reserved!", 3: "own"}
    assert all(not r.dropped for r in ld.line_report(docs).collect())
