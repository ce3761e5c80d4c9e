"""Manifest, proofs and tampering against plain hashing."""

import hashlib
import zlib

import duckdb
import pytest

from parley.llm import merkle, queries

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row, lowered=False):
    doc_id, text, lang, source, n_chars = row
    if lowered and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return h(*(field(x) for x in (doc_id, source, lang, n_chars, text)))


def paths(nodes):
    """Root and each leaf's [(before, after)] of a tree."""
    found, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run, j = nodes[k // 8 * 8 : k // 8 * 8 + 8], k % 8
            found[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
        nodes, at = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [k // 8 for k in at]
    return nodes[0], found


def plain(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: paths([leaf(r) for r in groups[x]]) for x in names}
    root, above = paths([trees[x][0] for x in names])
    out = []
    for x, up in zip(names, above, strict=True):
        for r, own in zip(groups[x], trees[x][1], strict=True):
            path = own + up
            acc = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for before, after in path:
                acc = h(before, acc, after)
            out.append((r[0], leaf(r), trees[x][0], root, h(*(b + a for b, a in path)), acc, acc == root))
    return out


def key(rows):
    return sorted(rows, key=repr)


def docs(spark, rows):
    # a column whose name clashes with ones that the operator adds
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, pos long")


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"en": 64}, {"en": 65, "de": 2}, {"en": 513, "zz": 7, "": 3}, {f"l{i}": 1 + i % 3 for i in range(20)}])
def test_against_plain_hashing(spark, sizes):
    rows = [(i * 7 + n, f"Text {i}", lang, "s", i) for n, (lang, size) in enumerate(sizes.items()) for i in range(size)]
    assert key(map(tuple, merkle.tamper_check(docs(spark, rows)).collect())) == key(plain(rows))


def test_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "", 0), (3, "A" * 300_000, "en", "s", 1), (None, "No id", "en", "s", 2), (None, "Other", "en", "s", 2), (4, "Ünïcode 日本", "É", "s", 3)]
    rows += [(5, "Same Row", "en", "s", 3)] * 70 + [(5, "Other text", "en", "s", 3)]
    assert key(map(tuple, merkle.tamper_check(docs(spark, rows)).collect())) == key(plain(rows))
    assert merkle.tamper_check(docs(spark, rows[:1]).limit(0)).count() == 0


def test_query_and_sql(spark):
    rows = duckdb.execute(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet'").fetchall()
    found = queries.op12_merkle_manifest(spark, SF)
    got = key(map(tuple, found.collect()))
    assert got == key(plain(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = con.execute(queries.ORACLE_SQL["op12_merkle_manifest"])
    names = [c[0] for c in sql.description]
    assert got == key(tuple(r[names.index(c)] for c in found.columns) for r in sql.fetchall())


def test_a_proof_shows_its_own_leaf_only(spark):
    rows = spark.createDataFrame([("g", i, h(str(i))) for i in range(30)], "group string, key long, node string")
    found, root = merkle.manifest(rows)
    own = found.select("node", merkle.fold(merkle.F.col("node"), merkle.F.col("path")).alias("right"), merkle.fold(merkle.F.lit(h("x")), merkle.F.col("path")).alias("wrong")).collect()
    assert len(own) == 30 and all(r.right == root != r.wrong for r in own)
