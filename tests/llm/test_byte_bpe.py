import hashlib
import struct

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.byte_bpe import VOCABULARY, Coder, decode, encode

PATH = P.path(VOCABULARY)
CODER = Coder(PATH, P.PATTERN)
ORACLE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODER.ranks, special_tokens={})


def packed(text):
    ids = ORACLE.encode_ordinary(text)
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_ids_are_tiktokens_and_decode_gives_the_text_back(texts):
    got = CODER.encode(texts)
    assert got == [packed(t) for t in texts]
    assert [CODER.decode(x) for x in got] == [t.encode() for t in texts]


def test_rows(spark):
    rows = [(1, "Élan 'tis  \n x"), (2, None), (3, ""), (4, "ab" * 100_000), (1, "Élan 'tis  \n x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' as ids", "'old' as decoded")
    got = decode(encode(df)).collect()
    assert sorted((r.doc_id, hashlib.sha256(r.ids).hexdigest(), r.decoded) for r in got) == sorted((i, hashlib.sha256(packed(t or "")).hexdigest(), (t or "").encode()) for i, t in rows)
    once = encode(df, keep_text=False, with_decoded=True)
    assert once.columns == ["doc_id", "ids", "decoded"]
    assert sorted(map(tuple, once.collect()), key=str) == sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=str)
    assert decode(encode(df.limit(0))).count() == 0
