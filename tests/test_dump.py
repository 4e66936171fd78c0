"""A JSON array read by ranges gives the items that a plain parser gives, wherever it is cut."""

import json
import random

import pytest

from scanlens.plans.store import Store
from scanlens.sources import dump

from .fixtures import extended, item

ODD = ['say "x", [y], {z}', "\\", "\\\\", 'ends in \\"', "é漢🙂", "\n\t", ",,[[{{", '"', "", "]", "\\u0041\\"]


def array(rng, n):
    def value(depth):
        match rng.randrange(5 if depth < 3 else 3):
            case 0:
                return rng.choice([1, -2.5, True, None, 10**20])
            case 1 | 2:
                return "".join(rng.choices(ODD, k=rng.randrange(3)))
            case 3:
                return [value(depth + 1) for _ in range(rng.randrange(4))]
            case _:
                return {rng.choice(ODD): value(depth + 1) for _ in range(rng.randrange(4))}

    return [value(0) for _ in range(n)]


def whole(path, size):
    """All items by ranges of `size` bytes, without Spark."""
    data = path.read_bytes()
    quoted = escaped = False
    depth = before = 0
    out, began = [], False
    for start in range(0, len(data), size):
        end = min(len(data), start + size)
        q, e, deeper, commas, opens = dump.summary(str(path), start, end, quoted, escaped)
        items = commas.get(1 - depth, 0) + (opens.get(-depth, 0) if not began else 0)
        began |= items > 0
        got = list(dump.items_of(str(path), dump.Range(start, end, quoted, escaped, depth, before, items)))
        assert len(got) == items or (len(got) == 0 and len(json.loads(data)) == 0)
        out += got
        quoted, escaped, depth, before = q, e, depth + deeper, before + items
    assert (quoted, depth) == (False, 0)
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
def test_any_range_size(tmp_path, size, monkeypatch):
    rng, path = random.Random(size), tmp_path / "a.json"
    for n in (0, 1, 2, 9, 30):
        said = array(rng, n)
        path.write_text(json.dumps(said, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])))
        for step in (1, 5, 1 << 20):
            monkeypatch.setattr(dump, "STEP", step)
            found = whole(path, size)
            assert [i for i, _ in found] == list(range(1, n + 1)) and [json.loads(t) for _, t in found] == said


@pytest.mark.parametrize("size", [11, 500, 1 << 20])
def test_read_items(spark, tmp_path, size):
    path = tmp_path / "a.T1w.json"
    said = [{"n": i, "text": random.Random(i).choice(ODD) * (i % 40)} for i in range(60)]
    path.write_text("  " + json.dumps(said) + "\n")
    rows = sorted(dump.read_items(spark, str(path), range_bytes=size).collect(), key=lambda r: r.item_index)
    assert [json.loads(r.value) for r in rows] == said and rows[4].raw_payload_path == f"{path}#item=5"
    assert sorted(r.item_index for r in dump.read_items(spark, str(path), 57, range_bytes=size).collect()) == [58, 59, 60]


def test_resuming_reads_from_the_place(spark, tmp_path):
    path = tmp_path / "a.T1w.json"
    path.write_text(json.dumps([{"n": i} for i in range(1000)]))
    found = dump.index(spark, str(path), 100)
    left = found.after(990)
    assert sum(r.end - r.start for r in left) <= 300 and sum(r.items for r in found.ranges) == 1000
    assert dump.Index.of_json(found.as_json()) == found
    assert dump.read_items(spark, str(path), 990, known=found).count() == 10 and found.after(1000) == []


@pytest.mark.parametrize("text", ['[{"a": 1}', '{"a": 1}', '["x', "", "  ", '[{"a": 1}, {"b": }]'])
def test_what_is_no_array(spark, tmp_path, text):
    path = tmp_path / "a.json"
    path.write_text(text)
    with pytest.raises(Exception, match="doesn't end|is a JSON array|isn't JSON"):
        dump.read_items(spark, str(path)).collect()


def test_a_store_keeps_the_index(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "dump", Store(spark, str(tmp_path / "store"))
    root.mkdir()
    path = root / "archive.bold.json"
    path.write_text(json.dumps([extended(item("bold", "a"))]))
    made, index = [], dump.index
    monkeypatch.setattr(dump, "index", lambda *a, **k: made.append(1) or index(*a, **k))
    for _ in range(2):
        assert store.dump_index(str(path)).ranges[0].items == 1
    path.write_text(json.dumps([extended(item("bold", x)) for x in "ab"]))
    assert sum(r.items for r in store.dump_index(str(path)).ranges) == 2 and len(made) == 2
