"""JSON arrays by byte ranges against a plain parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siltstone.sources import arrays, files


def odd_values(rng, n):
    out = []
    for i in range(n):
        text = "".join(rng.choice(['"', "\\", "\\\\", "[", "]", "{", "}", ",", "é", "漢", "\n", "a", " ", "\\\""]) for _ in range(rng.randrange(0, 40)))
        out.append(rng.choice([i, None, text, [text, [i]], {"instruction": text, "output": [i, {"x": text}]}, {"instruction": "q", "input": text}, {}, []]))
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_elements(spark, tmp_path, size, indent, monkeypatch):
    monkeypatch.setattr(arrays, "FURTHER", 13)
    values = odd_values(random.Random(size), 12 if size == 1 else 150)
    text = json.dumps(values, ensure_ascii=False, indent=indent)
    (tmp_path / "a.json").write_text(" \n" + text + "\n", encoding="utf-8")
    file = arrays._File(f"file://{tmp_path}/a.json")
    # the states that the plan sums up, and the elements of each range
    in_string, depth, got = False, 0, []
    for start in range(0, file.size, size):
        got += [json.loads(e) for e in arrays.elements(file, start, min(start + size, file.size), in_string, depth) if e.strip()]
        data, escaped = file.read(start, start + size), file.escaped(start)
        free = arrays._outside(data, escaped, in_string)
        depth += int(arrays._STEP[data][free].sum())
        in_string ^= len(arrays.quotes(data, escaped)) % 2 == 1
    assert got == values and depth == 0 and not in_string
    if size in (64, 1000):
        read = arrays.read_json_arrays(spark, str(tmp_path), size=size)
        key = lambda x: json.dumps(x, sort_keys=True)
        assert sorted((json.loads(r.raw) for r in read.collect()), key=key) == sorted(values, key=key)


def test_a_large_array_goes_to_several_tasks(spark, tmp_path):
    rows = [{"instruction": f"question {i}, [with] \"marks\"", "output": "x" * (i % 90)} for i in range(20_000)]
    (tmp_path / "big.json").write_text(json.dumps(rows))
    read = arrays.read_json_arrays(spark, str(tmp_path), size=1 << 18)
    tasks = read.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 20_000 and len(tasks) > 3 and max(r["count"] for r in tasks) < 12_000


def test_what_is_no_array(spark, tmp_path):
    for name, text in {"a": "[]", "b": "", "c": '{"x": [1, 2], "y": 3}', "d": " [ ]", "e": "[1]", "f": "nonsense", "g": "[[], {}]"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(r.raw for r in arrays.read_json_arrays(spark, str(tmp_path)).collect()) == ["1", "[]", "{}"]
    (tmp_path / "h.jsonl").write_text('{"instruction": "a", "output": "b"}\n\n{"instruction": "a"}\n')
    report = files.upload_report(files.validate_upload(spark, str(tmp_path))).first()
    assert (report.total, report.valid, report.invalid) == (5, 1, 4)
