"""The line signatures are of the very shingles that the exact Jaccard is of, and no pair of a bucket is left out that has the Jaccard asked for."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tilewright.llm import line_dedup


def letters(rng, n, of="bcdfghijklmnopqrstuvwxyz"):
    return "".join(of[i] for i in rng.integers(0, len(of), n))


def kept(spark, lines):
    return line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).where("kept_lines > 0").count()


def jaccard(a, b):
    x, y = ({s[k : k + 5] for k in range(max(1, len(s) - 4))} for s in (a, b))
    return len(x & y) / len(x | y)


def test_long_words_with_one_letter_changed(spark):
    """Word pairs change where one letter does; of the shingles only five do, fewer than there are bands."""
    rng = np.random.default_rng(8)
    lines = [" ".join(letters(rng, 20) for _ in range(4)) for _ in range(150)]
    edited = [s[: (k := 20 + int(rng.integers(20)))] + "#" + s[k + 1 :] for s in lines]
    assert all(jaccard(*p) >= 0.8 for p in zip(lines, edited, strict=True))
    assert kept(spark, lines + edited) == len(lines)


def test_changes_where_a_glance_would_look(spark):
    """All four letters a are changed, so that of the shingles that begin with one none is shared; the lines are alike all the same."""
    rng = np.random.default_rng(9)
    lines = []
    for _ in range(40):
        s = letters(rng, 200)
        for k in (30, 70, 110, 150):
            s = s[:k] + "a" + s[k + 1 :]
        lines.append(s)
    edited = [s.replace("a", "0") for s in lines]
    assert all(jaccard(*p) >= 0.8 for p in zip(lines, edited, strict=True))
    assert kept(spark, lines + edited) <= len(lines) + 1  # a band is missed by about one pair in 500


def test_signature_is_of_the_shingles(spark):
    cases = ["A bc Def", "日本語のテキスト😀é", "abc", "abcde", "😀a", "ab" * 60, "x"]
    frame = spark.createDataFrame(list(enumerate(cases)), "id bigint, line string")
    got = {r.id: r for r in line_dedup.windows(frame).groupBy("id").agg(F.count("*").alias("w"), F.count_distinct("v").alias("n")).collect()}
    assert [(got[i].w, got[i].n) for i in range(len(cases))] == [(max(1, len(t) - 4), len({t.lower()[k : k + 5] for k in range(max(1, len(t) - 4))})) for t in cases]
    # lines of the same few shingles are equal in all bands, however long they are
    assert kept(spark, ["ab" * 60, "ab" * 3000]) == 1


def test_bitmaps_never_rule_out_alike_lines(spark):
    rng = np.random.default_rng(10)
    base = [letters(rng, n, "abcdefgh") for n in (6, 12, 30, 90, 400, 2500)]
    pairs = []
    for b in base:
        for edits in range(6):
            c = list(b)
            for at in rng.integers(0, len(c), edits * len(b) // 100 + (edits > 0)):
                c[at] = "z"
            pairs.append((b, "".join(c)))
    lines = sorted({s for p in pairs for s in p})
    at = {s: i for i, s in enumerate(lines)}
    signed = line_dedup.signatures(spark.createDataFrame([(i, s) for s, i in at.items()], "id bigint, line string").repartition("id"))
    both = spark.createDataFrame(sorted({(at[a], at[b]) for a, b in pairs}), "a bigint, b bigint")
    got = {(r.a, r.b): r.ok for r in line_dedup.sides(both, signed).select("a", "b", line_dedup.possible(0.8)("l_", "r_").alias("ok")).collect()}
    alike = [(at[a], at[b]) for a, b in pairs if jaccard(a, b) >= 0.8]
    assert len(alike) > 10 and all(got[p] for p in alike) and not all(got.values())


def test_long_lines_that_are_not_alike_are_ruled_out(spark):
    """Their bitmaps are so full that hardly a bit of what only one of them has would be seen, were it not for the parities; lines of other sizes go by their sizes."""
    rng = np.random.default_rng(12)
    lines = [letters(rng, n, "abcdefgh") for n in (700, 1000, 1400)]
    half = [s[: len(s) // 2] + letters(rng, len(s) - len(s) // 2, "abcdefgh") for s in lines]
    again = [s + s[:100] for s in lines]  # windows that are there already count once
    every = [*lines, *half, *again]
    signed = line_dedup.signatures(spark.createDataFrame(list(enumerate(every)), "id bigint, line string").repartition("id"))
    pairs = [(i, j) for i in range(len(every)) for j in range(i)]
    got = {(r.a, r.b): r.ok for r in line_dedup.sides(spark.createDataFrame(pairs, "a bigint, b bigint"), signed).select("a", "b", line_dedup.possible(0.8)("l_", "r_").alias("ok")).collect()}
    assert got == {(i, j): jaccard(every[i], every[j]) >= 0.8 for i, j in pairs} and sum(got.values()) == len(lines)


def test_windows_without_a_lambda(spark):
    texts = ["", "ab", "Abcde", "abcdeabcde", "𝄞é" * 9 + "x\ny", "a" * 3000]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, line string")
    once = line_dedup.windows(frame, once=True)
    assert "lambdafunction" not in once._jdf.queryExecution().optimizedPlan().toString()
    wanted = {(i, len({t.lower()[k : k + 5] for k in range(max(1, len(t) - 4))})) for i, t in enumerate(texts) if t}
    assert {(r.id, r["count"]) for r in once.distinct().groupBy("id").count().collect()} == wanted


def test_every_shingle_is_in_a_bitmap(spark):
    """Of one shingle an odd number of bits is left over, so that all of a line's bits tell whether its shingles are odd or even in number."""
    rng = np.random.default_rng(13)
    lines = [letters(rng, n) for n in range(3, 90)] + ["日本語のテキスト😀é" * k for k in (1, 2)]
    signed = line_dedup.signatures(spark.createDataFrame(list(enumerate(lines)), "id bigint, line string").repartition("id"))
    bits = sum(F.bit_count(c) for c in signed.columns if c.startswith("b"))
    assert [r.n % 2 for r in signed.select("id", bits.alias("n")).orderBy("id").collect()] == [len({s[k : k + 5] for k in range(max(1, len(s) - 4))}) % 2 for s in lines]


def test_lines_somewhat_below_the_threshold_are_ruled_out(spark):
    """Twice as many different shingles as a Jaccard of 0.8 allows aren't let through to be compared as texts."""
    rng = np.random.default_rng(14)
    base = [letters(rng, 300) for _ in range(40)]
    far = [s[: 300 - 55] + letters(rng, 55) for s in base]
    assert all(0.65 < jaccard(*p) < 0.75 for p in zip(base, far, strict=True))
    signed = line_dedup.signatures(spark.createDataFrame(list(enumerate(base + far)), "id bigint, line string").repartition("id"))
    pairs = spark.createDataFrame([(i, i + 40) for i in range(40)], "a bigint, b bigint")
    assert line_dedup.sides(pairs, signed).where(line_dedup.possible(0.8)("l_", "r_")).count() == 0


def test_shingles_are_made_once(spark):
    """Their rows come from a compiled explode, and no filter makes the array a second time."""
    out = line_dedup.signatures(spark.createDataFrame([(1, "one line of text"), (2, "x"), (3, "another line of text")], "id long, line string"))
    assert {r.id: r.w for r in out.collect()} == {1: 12, 2: 1, 3: 16}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "*(" in plan.split("Generate explode")[0].split("\n")[-1] and "size(" not in plan
