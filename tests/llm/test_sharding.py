import hashlib
from collections import Counter

import pytest
import xxhash

from noticeloom.llm.queries import op10_sharding
from noticeloom.llm.sharding import lookup_table, place, write_shards

NAMES = tuple(f"s{i}" for i in range(7))


def owners(names, slots):
    """The owner of each slot, by shards that walk through their wishes in turns."""
    def order(name):
        d = hashlib.md5(name.encode()).digest()
        off, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        return iter([(off + k * skip) % slots for k in range(slots)])

    table, wishes = {}, {n: order(n) for n in names}
    while len(table) < slots:
        for n in sorted(names):
            if len(table) < slots:
                table[next(s for s in wishes[n] if s not in table)] = n
    return table


def brute(ids, names, slots=65_537):
    """Each id with its slot and shard; the hash of null is its seed."""
    table, out = owners(names, slots), []
    for i in ids:
        code = 42 if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)
        slot = (code - (1 << 64) if code >> 63 else code) % slots
        out.append((i, slot, table[slot]))
    return sorted(out, key=repr)


def test_turns_against_a_plain_simulation():
    names = ("b", "a", "c")
    table = owners(names, 13)
    assert [names[i] for i in lookup_table(names, 13)] == [table[s] for s in range(13)]


def test_even_loads_and_few_moves():
    table = lookup_table(NAMES)
    loads = Counter(table).values()
    assert max(loads) - min(loads) <= 1
    fewer = lookup_table(NAMES[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.1 * len(table)


@pytest.mark.parametrize("names, slots", [(("a",), 12), ((), 13), (("a", "a"), 13)])
def test_bad_parameters(names, slots):
    with pytest.raises(ValueError):
        lookup_table(names, slots)


def test_place(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    placed = place(docs.withColumn("slot", docs.doc_id), ["doc_id"], list(NAMES))
    rows = placed.collect()
    assert len(rows) == len(odd_rows)
    assert sorted(((r.doc_id, r.slot, r.shard) for r in rows), key=repr) == brute(
        [r[0] for r in odd_rows], NAMES)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert place(make_docs([]), ["doc_id"], list(NAMES)).collect() == []
    assert "Exchange hash" not in placed._jdf.queryExecution().toString()


def test_write_shards(spark, make_docs, odd_rows, tmp_path):
    write_shards(make_docs(odd_rows), ["doc_id"], list(NAMES), str(tmp_path / "out"), files=2)
    back = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "slot", "shard").collect()
    assert sorted(map(tuple, back), key=repr) == brute([r[0] for r in odd_rows], NAMES)


def test_query_places_whole_documents(spark, make_docs, odd_rows, tmp_path):
    make_docs(odd_rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = op10_sharding(spark, str(tmp_path)).select("doc_id", "text_sha256").collect()
    want = [(i, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t in odd_rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    make_docs([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert op10_sharding(spark, str(tmp_path / "none")).collect() == []
