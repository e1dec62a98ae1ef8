"""The registered queries of the subpackage against their SQL, on the smallest tables."""

import os

import pytest

from stridewell.llm import queries
from tools import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    said = compare.compare(spark, duck, FOLDER, name)
    assert said.startswith(("equal", "rows")), said


def test_packing_of_the_documents(spark):
    """Every text comes out whole, none is cut that fits, no container overflows, and little space is left."""
    from stridewell.llm import tokens
    from stridewell.sources.tables import table

    docs = table(spark, FOLDER, "documents")
    size = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()}
    pieces, fill = {}, {}
    for r in queries.p9_containers(spark, FOLDER).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start_token, r.n_tokens))
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert set(pieces) == set(size)
    for k, p in pieces.items():
        p.sort()
        assert sum(x[2] for x in p) == size[k] and (len(p) == 1 or size[k] > 2048)
        assert all(a[1] + a[2] == b[1] for a, b in zip(p, p[1:]))
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(size.values()) // 2048) + 1


def test_splits_of_the_decisions(spark):
    rows = queries.p2_splits(spark, FOLDER).collect()
    split = {}
    for r in rows:
        if r.user_id:
            assert split.setdefault(r.user_id, r.split) == r.split
    for r in queries.p2_found(spark, FOLDER).collect():
        assert split[r.user_a] == split[r.user_b]
