"""The manifest of volumes against trees built by hand in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from leafscribe.llm.manifest import Append, folded, record_digest, volume_manifest, witness_digest

SCHEMA = "doc_id long, name string, manifest_id string, page_number int, text string"
FIELDS = ("manifest_id", "page_number", "name", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Root, and for each leaf its siblings level by level."""
    level, proofs, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            a = p // 3 * 3
            run = level[a : a + 3]
            proofs[i].append(("".join(run[: p - a]), "".join(run[p - a + 1 :])))
        level = [sha("".join(level[a : a + 3])) for a in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], proofs


def expected(rows):
    """(leaf, subroot, root, witness) of each row, as a sorted list."""
    volumes = {}
    for _, name, volume, page, text in rows:
        volumes.setdefault(volume, []).append((page is not None, page or 0, leaf(volume, page, name, text)))
    order = sorted(volumes, key=lambda v: (v is not None, (v or "").encode()))
    built = {v: ([x for *_, x in sorted(volumes[v])], *tree([x for *_, x in sorted(volumes[v])])) for v in order}
    root, tops = tree([built[v][1] for v in order])
    out = []
    for v, top in zip(order, tops, strict=True):
        leaves, subroot, proofs = built[v]
        out += [(x, subroot, root, tuple(p + top)) for x, p in zip(leaves, proofs, strict=True)]
    return sorted(out)


def found(df, **options):
    rows = volume_manifest(df, **options).collect()
    return sorted((r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.witness)) for r in rows)


def volume_rows(sizes, seed=3):
    draw = random.Random(seed)
    rows = [
        (n, f"{v}_{p:05d}.jpg", v, p, draw.choice([None, "", "Anno 1703\nden 4 maj", f"rad {p}", "åäö 🙂"]))
        for v, size in sizes.items()
        for n, p in enumerate(range(1, size + 1))
    ]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 81, 82])
def test_append_keeps_witnesses(n):
    leaves = [sha(str(i)) for i in range(n)]
    grown = Append(8)
    for x in leaves:
        grown.add(x)
    root, proofs = tree(leaves)
    assert grown.close(True) == root
    for node, proof in zip(grown.leaves, proofs, strict=True):
        sides = []
        while node.parent is not None:
            sides.append((node.before, node.after))
            node = node.parent
        assert sides == proof


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_blocks_give_the_same_tree(spark, levels):
    rows = volume_rows({"R0001203": 61, "A0068547": 27, "R0000001": 1, None: 9, "Ö1": 10, "": 2, "r": 28})
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, levels=levels) == expected(rows)


def test_hard_rows(spark):
    # Nulls in every column, repeated rows, equal page numbers, a very long text.
    rows = [(None, None, None, None, None)] * 3 + [(1, "a", "V", 1, "x"), (1, "a", "V", 1, "x"), (2, "b", "V", 1, "y" * 200_000)]
    rows += [(3, "c", "V", None, "")] * 5
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.withColumns({c: F.lit("x") for c in ["volume", "pos", "digest", "kept", "block", "root", "witness", "salt", "page"]})
    assert found(clash, levels=1) == expected(rows)
    assert found(df.limit(0)) == []


def test_one_volume_holds_most_pages_in_blocks(spark):
    rows = volume_rows({"R0001203": 700, "A1": 5})
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5), levels=2) == expected(rows)


def test_tampered_pages_do_not_verify(spark):
    rows = volume_rows({"R0001203": 40, "A1": 13})
    df = spark.createDataFrame(rows, SCHEMA)
    bad = F.crc32(F.col("name")) % 2 == 0
    text = F.when(bad, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = record_digest(F.col("manifest_id"), F.col("page_number"), F.col("name"), text)
    out = volume_manifest(df.withColumn("claimed", claimed).withColumn("was", F.col("text")), FIELDS, ["claimed", "name", "was"])
    out = out.withColumn("folded_root", folded(F.col("claimed"), F.col("witness")))
    out = out.withColumn("proof", witness_digest(F.col("witness"))).collect()
    assert len(out) == 53
    for r in out:
        changed = zlib.crc32(r.name.encode()) % 2 == 0 and "\n" in (r.was or "")
        assert (r.folded_root == r.root) is not changed
        assert r.proof == sha("".join(s.before + s.after for s in r.witness))


def test_digest_of_fields(spark):
    row = spark.createDataFrame([(7, None, "åä")], "a long, b string, c string")
    got = row.select(record_digest(F.col("a"), F.col("b"), F.col("c")).alias("d")).first().d
    assert got == sha("1:7-4:åä")
