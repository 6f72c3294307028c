import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SMALL
from helpers import no_documents, odd_documents
from ranksheaf.llm import packing, registry

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return Tokenizer.from_file(PATH)


def checked(rows, texts, coder, length=1024):
    ids = [coder.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for s, pieces in at.items():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end and n > 0
            end += n
        assert end == length or s == max(at)
    assert sorted(at) == list(range(len(at)))
    return ids


def test_pieces_are_the_tokens(spark, coder):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = registry.op8_pack(spark, SMALL).collect()
    ids = dict(zip((d.doc_id for d in docs), checked(rows, [d.text for d in docs], coder), strict=True))
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert (zlib.crc32(part), r.doc_tokens) == (r.ids_crc32, len(ids[r.doc_id]))


@pytest.mark.parametrize("length", [7, 1024])
def test_odd_cases(spark, coder, length):
    docs = odd_documents(spark)
    rows = packing.pack(docs.repartition(5), PATH, length).collect()
    checked(rows, [r.text for r in docs.collect()], coder, length)
    assert packing.pack(no_documents(spark), PATH).count() == 0


@pytest.mark.parametrize(
    "text", ["", " ", "  ", "a  b", "a \n b", "a\n b", "tab\t x", "end ", " start", "don't  stop", "x  y", "\0 a\0b", "é ü 你好 สวัสดี", "a\x85 b", "a\x1c b", "  x", "<|endoftext|> x", "1234 56.7 !!! ...", "퟿ a"]
)
def test_ids_are_the_tokenizers(coder, text):
    own = packing.Encoder(PATH).ids(text)
    assert np.frombuffer(own, "<u4").tolist() == coder.encode(text, add_special_tokens=False).ids


def test_blank_lines_and_long_texts(spark, coder, monkeypatch):
    texts = [r.text.replace(". ", ".\n\n", 3) + "\n\n \n  end" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += ["\n\n".join(texts[:60]), "x" * 300_000, "y" * 300 + " " * 5000 + "z", "a\n \tb\x1c c\x85 d" * 900, "<|endoftext|> a b" * 500]
    own = packing.Encoder(PATH)
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == coder.encode(t, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "SEGMENT", 50)
    for t in (x for x in texts if len(x) < 50_000):
        assert np.frombuffer(own.ids(t), "<u4").tolist() == coder.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, "merges", "lstrip"])
def test_other_tokenizers_are_refused(tmp_path, change):
    file = json.load(open(PATH, encoding="utf-8"))
    if change == "merges":
        file["model"]["merges"].reverse()
    elif change == "lstrip":
        file["added_tokens"][0]["lstrip"] = True
    else:
        file |= change
    (tmp_path / "t.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        packing.Encoder(str(tmp_path / "t.json"))


def test_added_tokens_have_their_own_ids(spark):
    plain = Tokenizer.from_file(PATH)
    texts = ["a<|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  b", "a <|endoftext|>\n", "<|endoftext|", "<<|endoftext|>>", "\0<|endoftext|>\0 a", "don't<|endoftext|>'t stop"]
    assert plain.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 2124]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        ids = np.array([*plain.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_tokens, r.length, r.ids_crc32) == (len(ids), len(ids), zlib.crc32(ids.tobytes())), texts[r.doc_id]
