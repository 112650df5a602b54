import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
REAL = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.Encoder(RANKS, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=80) | st.text(alphabet="ab 'd1\n\t\x1c\x85", max_size=60), max_size=4))
def test_as_the_library(texts):
    ids, counts = OWN.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(texts)] == [REAL.encode_ordinary(t) for t in texts] or not texts
    assert OWN.decode(ids).tobytes() == "".join(texts).encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 700, " " * 3000 + "x", "ñandú" * 300, "\U0001f600" * 200])
def test_long_pieces(text):
    ids, _ = OWN.encode([text])
    assert ids.tolist() == REAL.encode_ordinary(text)


def test_query(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello  wörld", "x"), (3, "Hello  wörld", "x")], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in bpe.digest(df).collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == 0 and rows[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    ids = REAL.encode_ordinary("Hello  wörld")
    assert rows[3].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert rows[3].decoded_sha256 == hashlib.sha256("Hello  wörld".encode()).hexdigest()
    path, pattern = bpe.public_vocabulary()
    again = bpe.decode(bpe.encode(df, path, pattern), path, pattern)
    assert sorted(bytes(r.decoded) for r in again.collect())[-1] == "Hello  wörld".encode()
    assert bpe.digest(df.limit(0)).count() == 0
