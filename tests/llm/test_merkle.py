import hashlib
import random
import zlib

import pytest

from tessella.llm import merkle
from tessella.llm.common import Scratch


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, tampered=False):
    row = list(row)
    if tampered and row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
        row[4] = row[4].replace("\n", "")
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def tree(nodes):
    """The root, and the siblings of each node with its place among them, level by level."""
    steps, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for k in run:
                for i in under[k]:
                    steps[i].append((k - run[0], [nodes[j] for j in run if j != k]))
        nodes, under = [H(*[nodes[k] for k in run]) for run in runs], [sum((under[k] for k in run), []) for run in runs]
    return nodes[0], steps


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, out = [], []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, steps = tree([leaf(r) for r in own])
        tops.append(top)
        out.append(list(zip(own, steps, strict=True)))
    root, above = tree(tops)
    result = []
    for top, more, own in zip(tops, above, out, strict=True):
        for r, steps in own:
            digest = leaf(r, True)
            for k, others in steps + more:
                digest = H(*others[:k], digest, *others[k:])
            result.append((r[0], leaf(r), top, root, H(*[x for _, others in steps + more for x in others]), digest, digest == root))
    return result


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_all_sizes_of_groups(spark, height):
    """Groups of 1 to 40 rows, blocks smaller and larger than they."""
    rng = random.Random(height)
    rows = [(1000 * g + i if g % 3 else -i, f"s{g}", rng.choice(["en", None]), i, rng.choice(["a\nb", "c", None, "é\n\n"])) for g, n in enumerate([1, 2, 3, 4, 9, 10, 27, 28, 40]) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert rows_of(merkle.document_proofs(df, height)) == sorted(expected(rows), key=str)


def test_query(spark, small):
    from tessella.llm.common import table

    rows = [tuple(r) for r in table(spark, small, "documents").select(*merkle.COLUMNS).collect()]
    got = merkle.op11_merkle(spark, small)
    assert rows_of(got) == sorted(expected(rows), key=str)
    assert 0 < got.where("verified").count() < len(rows)


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    assert rows_of(merkle.document_proofs(odd)) == sorted(expected(rows), key=str)
    assert merkle.document_proofs(nothing).collect() == []


def test_one_row(spark):
    df = spark.createDataFrame([(7, None, None, None, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    r = merkle.document_proofs(df).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == H()


def test_hot_group_is_parted(spark):
    """A group of all rows reaches every partition of the order, and no block holds more than its nodes."""
    rows = [(i, "hot", "en", i, str(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    work = Scratch(spark, "merkle")
    at = merkle.placed(merkle.leaves(df, work), "source", ["doc_id", "leaf", "u"], work)
    assert sorted(r.pos for r in at.collect()) == list(range(2000)) and {r.n for r in at.collect()} == {2000}
    done = merkle._climb(at.selectExpr("0L AS g", "pos", "n", "leaf AS digest"), 3, work)
    assert done.groupBy("block").count().agg({"count": "max"}).first()[0] == 27


def test_tampering_shows(spark):
    """A changed leaf folds to another root, an unchanged one to the root."""
    nodes = [hashlib.sha256(str(i).encode()).digest() for i in range(100)]
    root, steps = merkle.traverse(nodes, merkle.levels(100))
    assert all(merkle.fold(d, s) == root for d, s in zip(nodes, steps, strict=True))
    assert all(merkle.fold(b"\0" * 32, s) != root for s in steps)
