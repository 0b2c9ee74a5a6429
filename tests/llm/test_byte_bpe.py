import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from tesserae.llm import byte_bpe as b


@pytest.fixture(scope="module")
def tool():
    path, pattern = b.production()
    return path, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=b.load_ranks(path), special_tokens={})


ODD = ["", " ", "\n\n", "a", "a" * 5000, "ab" * 3000 + "é" * 500, "  \n\n x  ", "a\x1cb \x1c  c\x85\xa0 d​ e's  'S x\r\n\r\n y\t\tz ", "²x½ 9² _a_ ", "日本語 テキスト １２", "😀 it's we'll 'tis <|endoftext|>", " \x1f\x1f z"]


def test_ids_are_the_tools(spark, tool):
    path, pattern, own = tool
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab é'sd12 .,!\n\t ") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    rows = b.decode(b.encode(frame, path, pattern), path).collect()
    assert [r.ids for r in rows] == [own.encode_ordinary(r.text) for r in rows]
    assert all(bytes(r.decoded).decode() == r.text for r in rows)


def test_perfect_hash():
    ranks = {f"k{i}".encode(): i for i in range(3000)}
    t = b.TokenHash(ranks)
    assert sorted(t.ranks) == list(range(3000)) and all(t.get(k) == r for k, r in ranks.items()) and t.get(b"none") is None


def test_edges(spark, tool):
    path, pattern, own = tool
    frame = spark.createDataFrame([(1, None, "x"), (1, "same", "y"), (1, "same", "y"), (None, "t", None)], "doc_id long, text string, IDS string")
    rows = b.digests(frame, path, pattern).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert (rows[0].n_tokens, rows[0].ids_sha256, rows[0].decoded_sha256) == (0, empty, empty) and rows[1] == rows[2] and rows[3].doc_id is None
    ids = own.encode_ordinary("same")
    assert rows[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert b.digests(frame.limit(0), path, pattern).count() == 0
    with pytest.raises(Exception, match="in the vocabulary"):
        b.decode(spark.createDataFrame([([60_000],)], "ids array<int>"), path).collect()
    assert b.decode(spark.createDataFrame([(None,)], "ids array<int>"), path).first().decoded is None


def test_extra_columns_pass(spark, tool):
    frame = spark.range(2).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit(7).alias("other"))
    assert b.encode(frame, tool[0], tool[1]).columns == ["doc_id", "text", "other", "ids"]


def test_merge_is_the_plain_rule(tool):
    """Lowest rank first, leftmost on ties, whether the first ranks are given or not; against a plain loop."""
    ranks = b.load_ranks(tool[0])
    pairs, rng = b.pair_ranks(ranks), random.Random(6)
    whole, seen = b.TokenHash(ranks), []
    encoder = b.Encoder(whole, pairs, tool[1])
    for raw in [b"aaaaaaa", b"zq" * 40, *(bytes(rng.choices(b"abcdefghijkl0123", k=rng.randrange(2, 60))) for _ in range(200))]:
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while found := [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks]:
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = [ranks[p] for p in parts]
        ids = [ranks[bytes([c])] for c in raw]
        first = [encoder.byte_pairs[x][y] for x, y in zip(raw, raw[1:], strict=False)]
        assert b.merge(list(ids), pairs.get) == b.merge(list(ids), pairs.get, first) == want
        seen.append(len(want) < len(raw))
    assert any(seen)
