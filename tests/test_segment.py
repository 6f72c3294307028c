import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from ranksheaf.functions import segment, text
from ranksheaf.operators import evidence
from ranksheaf.plans import mechanisms

LEAD, MARKS = "เแโใไ", "ะาำๅ" + "".join(map(chr, (0x0E31, *range(0x0E34, 0x0E3B), *range(0x0E47, 0x0E4F))))


def places(run):
    """Boundaries of clusters, character by character."""
    out = [0]
    for i in range(1, len(run)):
        if run[i] not in MARKS and run[i - 1] not in LEAD:
            out.append(i)
        elif run[i] in MARKS and i - 1 in out[1:] + [0] and run[i - 1] in LEAD:
            pass  # a mark after a bare leading vowel stays with it
    return [*out, len(run)]


def brute(run, words):
    """Among all paths: fewest characters without a word, fewest words, then the longest first words; as (tokens)."""
    at = places(run)

    @cache
    def best(i):
        if i == len(at) - 1:
            return (0, 0, (), ())
        ways = []
        for j in range(i + 1, len(at)):
            piece = run[at[i] : at[j]]
            left, n, order, path = best(j)
            if piece in words:
                ways.append((left, n + 1, (-j, *order), ((piece, True), *path)))
            if j == i + 1:
                ways.append((left + len(piece), n, (-j, *order), ((piece, False), *path)))
        return min(ways, key=lambda w: (w[0], w[1], w[2]))

    tokens, loose = [], ""
    for piece, known in best(0)[3]:
        if known:
            tokens += [loose, piece] if loose else [piece]
            loose = ""
        else:
            loose += piece
    return tokens + [loose] if loose else tokens


def test_shortest_paths_are_those_of_all():
    rng = random.Random(2)
    for k in range(400):
        letters = "abก" if k % 2 else "กาเม่น"
        words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(9))}
        run = "".join(rng.choice(letters + "z") for _ in range(rng.randrange(1, 14)))
        assert segment.shortest(run, segment.automaton(sorted(words))) == brute(run, words), (run, words)


def test_thai_text(spark):
    words = ["ฉัน", "กิน", "ข้าว", "ผัด", "ข้าวผัด", "ที่", "บ้าน", "ตาก", "ตา", "กลม", "ลม"]
    model, kept = segment.DictionarySegmenter(words), segment.DictionarySegmenter(words, keep_blanks=True)
    assert model.segment(["ฉันกินข้าวผัดที่บ้าน", "ตากลม", "ฉัน ABC-x2 1,234.5กินแมว", "", "แมว"]) == [
        ["ฉัน", "กิน", "ข้าวผัด", "ที่", "บ้าน"], ["ตาก", "ลม"], ["ฉัน", "ABC-x", "2", "1,234.5", "กิน", "แมว"], [], ["แมว"],
    ]
    assert kept.segment([" ฉัน  กิน\n"]) == [[" ", "ฉัน", "  ", "กิน", "\n"]]
    df = spark.createDataFrame([("ฉันกินข้าว",), (None,)], "t string")
    assert [r.w for r in df.select(segment.segmented(words)(F.col("t")).alias("w")).collect()] == [["ฉัน", "กิน", "ข้าว"], []]


def test_a_word_never_ends_within_a_cluster():
    assert segment.shortest("นี้", segment.automaton(["น"])) == ["นี้"]
    assert segment.shortest("เก", segment.automaton(["เ", "ก"])) == ["เก"]


def test_the_dictionary_is_a_table_of_a_checked_size(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), (None,), ("",)], "word string")
    assert segment.dictionary(df) == ["a", "b"] and segment.dictionary(df.limit(0)) == []
    with pytest.raises(ValueError):
        segment.dictionary(df, most=1)


def test_documents_are_cut_into_their_words(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    words = set(segment.dictionary(mechanisms.counted_dictionary(docs)))
    got = {r.doc_id: r for r in mechanisms.dictionary_segmentation(spark, SMALL).collect()}
    rows = docs.select("doc_id", text.words(F.col("text")).alias("w")).collect()
    assert len(got) == len(rows)
    found = total = 0
    for r in rows:
        x = got[r.doc_id]
        assert x.n_words == len(r.w) and x.n_ends_found <= x.n_words
        found, total = found + x.n_ends_found, total + x.n_words
    assert found > 0.7 * total  # a quarter of the words of so small a table stand in fewer than three documents
    import hashlib

    for r in [r for r in rows if len(r.w) < 150][:25]:
        run = "".join(r.w)
        assert got[r.doc_id].tokens_md5 == hashlib.md5(" ".join(brute(run, words) if run else []).encode()).hexdigest()


def test_questions_can_be_asked_over_a_dictionary(spark):
    docs = spark.createDataFrame([(1, "ฉันกินข้าวผัดที่บ้าน\nตากลมที่บ้าน")], "doc_id long, text string")
    words = ["ฉัน", "กิน", "ข้าวผัด", "ที่", "บ้าน", "ตาก", "ลม"]
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    tokens = [r.t for r in lines.select(segment.segmented(words)(F.col("line")).alias("t")).collect()]
    assert tokens == [["ฉัน", "กิน", "ข้าวผัด", "ที่", "บ้าน"], ["ตาก", "ลม", "ที่", "บ้าน"]]
    assert evidence.paragraphs(docs).count() == 2


def test_ends_are_running_lengths(spark):
    df = spark.createDataFrame([(["ab", "ก", "cde"],), ([],), (None,), (["x"],)], "w array<string>").coalesce(1)
    assert [r.e for r in df.select(segment.ends("w").alias("e")).collect()] == [[2, 3, 6], [], [], [1]]


def test_long_texts_take_time_in_proportion(spark):
    df = spark.range(1).selectExpr("transform(sequence(1, 400000), x -> 'ab') AS w")
    assert df.select(F.element_at(segment.ends("w"), -1).alias("last")).first().last == 800000
