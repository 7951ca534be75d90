"""Entity files by byte ranges against json.load, at every size of a range."""

import io
import json
import random

import pytest

from kinmap.sources import entities as ef

ODD = ['a', 'q"uote', 'back\\slash', 'br{ace', '}{', '["x"]', 'ü中', 'entities', 'tab\t', 'end\\', '\U0001f600', '":{', '']


def file_of(seed, indent, ascii_only, count=25):
    draw = random.Random(seed)
    some = lambda: [draw.randrange(10**draw.randrange(1, 12)) for _ in range(draw.randrange(4))]
    named = {f"{draw.choice(ODD)}{i}": {"src": some(), "type": draw.choice(ODD), "tgt": some(), "more": {"src": some(), "entities": {"z": {}}}} for i in range(count)}
    named["bare"] = {"src": None}
    before = {"dataset": "entities", "graphs": ["entities", {"entities": {"no": {"src": [1]}}}], "note\\": "x\\\"{"}
    after = {"metadata": {"entities": {"no": {}}, "deep": [[{"a": "}"}]]}, "last": "entities"}
    return json.dumps(before | {"entities": named} | after, indent=indent, ensure_ascii=ascii_only).encode(), named


def by_ranges(data, size):
    """The steps of the reader without Spark."""
    file, state, depth, entries, opens, closes = io.BytesIO(data), 0, 0, [], [], []
    for start in range(0, len(data), size):
        end, move, low = ef.effect(data[start : start + size])[state]
        entries.append((start, min(start + size, len(data)), state, depth, depth + low <= 1 or depth <= 1))
        state, depth = end, depth + move
    assert (state, depth) == (0, 0)
    for *entry, top in entries:
        if top:
            o, c = ef.marks(file, *entry)
            opens += o
            closes += c
    (first,) = opens
    last = min(c for c in closes if c >= first)
    return [row for *entry, _ in entries for row in ef.entities_in(file, *entry, first, last)]


@pytest.mark.parametrize("seed,indent,ascii_only", [(1, None, True), (2, 2, False), (3, 2, True), (4, None, False)])
def test_every_range_size_gives_what_the_whole_file_does(seed, indent, ascii_only):
    data, named = file_of(seed, indent, ascii_only)
    expected = [(k, v.get("src") or [], v.get("tgt") or []) for k, v in named.items()]
    for size in [*range(1, 60), 97, 255, 1000, 4096, len(data), 10 * len(data)]:
        assert [row[1:] for row in by_ranges(data, size)] == expected, size


def test_empty_objects_and_sums_of_ranges():
    assert by_ranges(b'{"entities": {}}', 3) == [] == by_ranges(b' {"a": [], "entities" : { } } ', 100)
    data, _ = file_of(5, None, False)
    for cut in range(0, len(data), 7):
        assert ef.composed(ef.effect(data[:cut]), ef.effect(data[cut:]))[ef.OUTSIDE] == ef.effect(data)[ef.OUTSIDE]


def test_files_in_many_tasks(spark, tmp_path):
    expected = []
    for seed in (7, 8):
        data, named = file_of(seed, 2, False, 200)
        (tmp_path / f"{seed}.json").write_bytes(data)
        expected += [(f"{seed}.json", k, v.get("src") or [], v.get("tgt") or []) for k, v in named.items()]
    found = ef.read(spark, str(tmp_path), 1_000)
    assert found.rdd.getNumPartitions() > 20
    assert sorted((r.file.rsplit("/", 1)[1], r.eid, r.src, r.tgt) for r in found.collect()) == sorted(expected)


@pytest.mark.parametrize("text", ['{"other": {}}', '{"entities": []}', '{"entities": {"a": {}}', '{"entities": {"a": "x"}}', '{"entities": {}, "entities": {}}', '[]'])
def test_what_is_no_entity_file_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="entities|object"):
        ef.read(spark, str(tmp_path)).collect()


def test_files_of_no_bytes_have_no_rows(spark, tmp_path):
    (tmp_path / "x.json").write_text("")
    assert ef.read(spark, str(tmp_path)).count() == 0


def test_round_trip_in_parts(spark, tmp_path):
    rows = [(0.1 * r, f"{name}{i}", side, n) for r in (1, 2) for i in range(20) for name in ODD for side in ("src", "tgt") for n in range(i % 3)]
    entities = spark.createDataFrame(rows, "rate double, eid string, side string, node long")
    ids = spark.createDataFrame([(0.1 * r, f"{name}{i}") for r in (1, 2) for i in range(20) for name in ODD] + [(0.1, None)], "rate double, eid string")
    ef.write(entities, ids, f"{tmp_path}/out", "rate", ids_per_part=100)
    files = sorted(tmp_path.glob("out/rate=*/part=*/*.txt"))
    assert len(files) == 2 * 6 and sum(len(json.loads(f.read_text())["entities"]) for f in files) == 2 * 20 * len(ODD)
    from kinmap.sources import networks

    back, there = networks.read_predictions(spark, f"{tmp_path}/out")
    assert sorted((round(r.rate, 6), r.eid, r.side, r.node) for r in back.collect()) == sorted((round(a, 6), *b) for a, *b in rows)
    assert sorted(r.eid for r in there.where("rate < 0.15").collect()) == sorted(f"{name}{i}" for i in range(20) for name in ODD)
    ef.write(entities.where("false"), ids.where("false"), f"{tmp_path}/none")
    assert ef.read(spark, f"{tmp_path}/none").count() == 0
