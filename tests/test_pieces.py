"""Byte ranges of a file: the same records however it is cut."""

import csv
import io
import json
import random

import pyarrow as pa
import pytest

from tallyfold import read_transactions
from tallyfold.errors import InvalidDataset
from tallyfold.sources import pieces

RANGES = [None, 7, 50, 333]


def texts(scan, paths=None):
    return [r.text for r in scan.records(paths).collect()]


def sure(records):
    return sorted(json.dumps(r, sort_keys=True) for r in records)


VALUES = [1, None, True, "x", 'a "q" }{][, \\ ', 'é\n},{"a":1', {"b": [1, {"c": "}"}]}, [{"z": 2}, "]"], 2.5, "}{" * 30, "\\", '\\"', "[{"]


@pytest.mark.parametrize("size", RANGES)
@pytest.mark.parametrize("seed", range(3))
def test_arrays_cut_anywhere(spark, tmp_path, seed, size):
    rnd, written = random.Random(seed), []
    for name in "ab":
        records = [{k: rnd.choice(VALUES) for k in rnd.sample("abcdef", rnd.randint(0, 5))} for _ in range(rnd.choice([0, 1, 9, 50]))]
        text = json.dumps(records, indent=rnd.choice([None, 2]), ensure_ascii=rnd.random() < 0.5)
        (tmp_path / f"{name}.json").write_text(rnd.choice(["", " \n"]) + text + rnd.choice(["", "\n"]))
        written += records
    scan = pieces.scan(spark, str(tmp_path), pieces.JSON, size)
    assert sure(json.loads(t) for t in texts(scan)) == sure(written)


def test_plain_arrays_are_whole_ranges(spark, tmp_path):
    records = [{"a": i, "b": f'text "{i}"'} for i in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps(records))
    scan = pieces.scan(spark, str(tmp_path), pieces.JSON, 10_000)
    assert len(scan.starts) > 5 and {s.state for s in scan.starts.values()} == {(0, 0), (0, 1)}
    df = scan.records()
    assert "collect_list" not in df._jdf.queryExecution().toString()  # nothing to put together
    assert sure(json.loads(t) for t in texts(scan)) == sure(records)


BROKEN = {
    '[{"a":1},{"a":2}': "byte 16",
    '[{"a":1},{"a":"x': "byte 16",
    '[{"a":1},': "byte 9",
    '[{"a":1}]\n[{"a":2}]': "nothing should follow the array at byte 8",
    '[{"a":1}] x': "nothing should follow the array at byte 8",
    '{"a":1}': "array of records should begin at byte 0",
    '{"a":1}\n{"a":2}': "at byte [07]",
    '[{"a":1}{"a":2}]': "comma or the end of the array should follow at byte 8",
    '[1,{"a":2}]': "record should begin at byte 0",
    '[{"a":1},]': "record should follow the comma at byte 8",
    '[{"a":1},null]': "record should follow the comma at byte 8",
    '[{"a":1]}]': "byte 10",
}


@pytest.mark.parametrize("size", [None, 5])
@pytest.mark.parametrize("text", BROKEN)
def test_broken_arrays_fail_with_file_and_byte(spark, tmp_path, text, size):
    (tmp_path / "good.json").write_text('[{"a":0}]')
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match=f"bad.json .*{BROKEN[text]}"):
        texts(pieces.scan(spark, str(tmp_path), pieces.JSON, size))


@pytest.mark.parametrize("text", ["", " \n", "[]", " [ \n ] \n"])
def test_arrays_without_records(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert texts(pieces.scan(spark, str(tmp_path), pieces.JSON, 3)) == []
    assert read_transactions(spark, str(tmp_path / "a.json")).count() == 0


@pytest.mark.parametrize("record", ['{"a":01}', '{"a" 1}', '{a}', '{"a":[}'])
def test_malformed_records_fail(spark, tmp_path, record):
    (tmp_path / "a.json").write_text(f'[{{"a":1}},{record}]')
    with pytest.raises(Exception, match="(?i)malformed|cut off|byte"):
        read_transactions(spark, str(tmp_path / "a.json"), schema="a string").collect()
    with pytest.raises(Exception, match="(?i)malformed|cut off|byte"):
        read_transactions(spark, str(tmp_path / "a.json")).collect()


@pytest.mark.parametrize("line", ['{"a":', "x", '{"a":1', '{"a":1}{"a":2}', '{"a":1} x', '{"a":1},', "null", "3", "[]"])
def test_malformed_lines_fail(spark, tmp_path, line):
    (tmp_path / "a.jsonl").write_text(f'{{"a":1}}\n{line}\n')
    for schema in (None, "a string"):
        with pytest.raises(Exception, match="(?i)malformed|INVALID_JSON_RECORD|cannot be cast|FAILFAST"):
            read_transactions(spark, str(tmp_path / "a.jsonl"), schema=schema).collect()


def test_lines_are_read_whole(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\n{"a":1}\n \t\n{"a":"}{"},{"a":3,"b":null}\r\n')
    for schema in (None, "a string, b string"):
        read = read_transactions(spark, str(tmp_path / "a.jsonl"), schema=schema)
        assert read.columns == ["a", "b"]
        assert sorted(r.a for r in read.collect()) == ["1", "3", "}{"]


def test_a_schema_is_kept_and_folders_name_columns(spark, tmp_path):
    for day in ("1", "2"):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "a.json").write_text(json.dumps([{"b": int(day), "a": "x"}, {"b": None, "a": "y" * 50}]))
    read = read_transactions(spark, str(tmp_path), fmt="json", schema="a string, b int, c string")
    assert read.columns == ["a", "b", "c", "day"]
    assert sorted((r.b or 0, r.day) for r in read.collect()) == [(0, 1), (0, 2), (1, 1), (2, 2)]
    scan = pieces.scan(spark, str(tmp_path), pieces.JSON, 10)
    assert sorted(r.day for r in scan.records().collect()) == [1, 1, 2, 2]


def test_ranges_stay_the_same_whatever_the_session_says(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": "}" * (i % 40)} for i in range(200)]))
    df = pieces.scan(spark, str(tmp_path), pieces.JSON, 64).records()
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "1000")
        assert df.count() == 200 and df.sparkSession is spark
        df.createOrReplaceTempView("ranged")
        assert spark.sql("select count(*) from ranged").first()[0] == 200
    finally:
        spark.conf.set(name, before)


def test_many_tasks_read_one_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": i, "b": "x" * 1000} for i in range(6000)]))
    read = read_transactions(spark, str(tmp_path / "a.json"))
    assert read.groupBy("a").count().count() == 6000
    assert read.rdd.getNumPartitions() >= 5


def test_records_of_many_groups_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pieces, "RANGES", 2)
    for i in range(5):
        (tmp_path / f"{i}.json").write_text(json.dumps([{"a": "}" * 9}] * 4))
    assert len(texts(pieces.scan(spark, str(tmp_path), pieces.JSON, 20))) == 20


FIELDS = ["", "x", "1 2", 'say "hi"', "a,b", "line\nbreak", '\n\n",\n"', '"', "é", " ", '""\n', "a\r\nb"]


def write_csv(path, rows, end, rnd):
    out = io.StringIO()
    for row in rows:
        csv.writer(out, lineterminator=end, quoting=rnd.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerow(row)
    path.write_bytes(out.getvalue().encode())


@pytest.mark.parametrize("size", [None, 40, 333])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv_cut_anywhere(spark, tmp_path, end, size, monkeypatch):
    rnd, rows = random.Random(size or 1), []
    for name, order in (("a", [0, 1, 2]), ("b", [2, 0, 1])):
        own = [[f"k{i}", rnd.choice(FIELDS), rnd.choice(FIELDS)] for i in range(40)]
        write_csv(tmp_path / f"{name}.csv", [[r[i] for i in order] for r in [["key", "p", "q"], *own]], end, rnd)
        rows += own
    real = pieces.scan
    monkeypatch.setattr(pieces, "scan", lambda spark, path, format: real(spark, path, format, size))
    read = read_transactions(spark, str(tmp_path), fmt="csv", multiline=True, drop_first_column=False)
    found = sorted((r.key, r.p or "", r.q or "") for r in read.collect())
    assert found == sorted(map(tuple, rows))


def test_quoted_csv_agrees_with_one_task_for_each_file(spark, tmp_path):
    rnd = random.Random(9)
    rows = [["key", "p", "q"], *([f"k{i}", rnd.choice(FIELDS), rnd.choice(FIELDS)] for i in range(300))]
    write_csv(tmp_path / "a.csv", rows, "\n", rnd)
    mine = read_transactions(spark, str(tmp_path / "a.csv"), multiline=True, drop_first_column=False)
    whole = spark.read.csv(str(tmp_path / "a.csv"), header=True, escape='"', multiLine=True)
    assert mine.columns == whole.columns
    assert sorted(map(str, mine.collect())) == sorted(map(str, whole.collect()))


def test_quoted_csv_faults(spark, tmp_path):
    def read(text, **options):
        (tmp_path / "a.csv").write_text(text)
        return read_transactions(spark, str(tmp_path / "a.csv"), multiline=True, drop_first_column=False, **options)

    with pytest.raises(InvalidDataset, match="cut off"):
        read('a,b\n1,"x\ny\n')
    with pytest.raises(InvalidDataset, match="no header"):
        read("\n\n")
    with pytest.raises(InvalidDataset, match="has the columns a, b"):
        read("a,b\n1,2\n", schema="a string, c string")
    with pytest.raises(Exception, match="(?i)malformed"):
        read('a,b\n1,"x\ny",3\n').collect()
    assert read('a,b\n\n1,"x\ny"\n  \n', schema="a int, b string").collect()[0][0] == 1
    assert read('a,b\na,b\n').count() == 1  # a row like the header is a row
    assert read('a,b\n1,5" pipe\n2,6" pipe\n').count() == 2  # quotes inside a field that does not begin with one


def test_header_over_the_first_range_fails(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('a,"long\nname"\n1,2\n3,4\n')
    real = pieces.scan
    monkeypatch.setattr(pieces, "scan", lambda spark, path, format: real(spark, path, format, 4))
    with pytest.raises(InvalidDataset, match="no header in its first range"):
        read_transactions(spark, str(tmp_path / "a.csv"), multiline=True)


def test_many_tasks_read_one_quoted_file(spark, tmp_path):
    rows = [["key", "text"], *([i, "x\n" * 400] for i in range(8000))]
    write_csv(tmp_path / "a.csv", rows, "\n", random.Random(1))
    read = read_transactions(spark, str(tmp_path / "a.csv"), multiline=True, drop_first_column=False)
    assert read.groupBy("key").count().count() == 8000
    assert read.rdd.getNumPartitions() >= 5


@pytest.mark.parametrize("inside", [0, 1])
def test_ends_inside_follows_each_character(inside):
    rnd = random.Random(inside)
    for _ in range(2000):
        line = "".join(rnd.choice('a",') for _ in range(rnd.randint(0, 8)))
        state, at = ("quoted" if inside else "start"), 0
        for at, c in enumerate(line):
            if state == "quoted":
                state = "quote" if c == '"' else "quoted"
            elif state == "quote":
                state = "quoted" if c == '"' else "start" if c == "," else "bare"
            elif state == "start":
                state = "quoted" if c == '"' else "start" if c == "," else "bare"
            elif c == ",":
                state = "start"
        assert pieces.ends_inside(line, inside) == (state == "quoted"), line


@pytest.mark.parametrize("seed", range(4))
def test_states_of_many_lines_follow_each_line(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        lines = ["".join(rnd.choice('ab",é\r') for _ in range(rnd.randint(0, 7))) for _ in range(rnd.randint(1, 12))]
        effect, ends = pieces.CsvEffect(False), [0, 1]
        cut = rnd.randint(0, len(lines))
        for part in (lines[:cut], lines[cut:]):
            effect.feed(pa.array(part, pa.string()))
        for line in lines:
            ends = [pieces.ends_inside(line, s) for s in ends]
        assert effect.effect() == ends, lines


def cut_records(lines, inside, sizes, whole=True, offset=5):
    """(kind, text) of the records of one range, its lines fed in batches of ``sizes``, and the number of arrays they left in."""
    reader = pieces.CsvRecords(pieces.Start(offset, (inside,), 10**6, "p"), *([] if whole else [False]))
    found, lines = [], list(lines)
    for n in sizes:
        found += reader.feed(pa.array(lines[:n], pa.string()))
        del lines[:n]
    found += [*reader.feed(pa.array(lines, pa.string())), *reader.close()]
    return [(kind, text) for kind, texts in found for text in texts.to_pylist()], len(found)


@pytest.mark.parametrize("seed", range(4))
def test_records_do_not_depend_on_batches(seed):
    rnd = random.Random(seed)
    for _ in range(200):
        lines = ["".join(rnd.choice('ab",\r ') for _ in range(rnd.randint(0, 5))) for _ in range(rnd.randint(0, 12))]
        inside = rnd.randint(0, 1)
        own, begun, state = [], [] if inside else None, inside
        for line in lines:
            begun, kind = ([] if begun is None else begun), pieces._HEAD if inside and not any(k == pieces._HEAD for k, _ in own) else pieces._WHOLE
            begun.append(line)
            state = pieces.ends_inside(line, state)
            if not state:
                text = "\n".join(begun).rstrip("\r")
                own += [(kind, text)] if kind == pieces._HEAD or text.strip() else []
                begun = None
        if begun is not None:
            own.append((pieces._HEAD if inside and not own else pieces._TAIL, "\n".join(begun) + "\n"))
        sizes = [rnd.randint(0, 4) for _ in range(4)]
        bare = lambda found: [(k, t if t.endswith("\n") else t.rstrip("\r")) for k, t in found]
        assert bare(cut_records(lines, inside, sizes)[0]) == own, (lines, inside)
        assert bare(cut_records(lines, inside, sizes, whole=False)[0]) == [r for r in own if r[0] != pieces._WHOLE], (lines, inside)


def test_records_with_line_breaks_leave_in_few_batches():
    lines = ["1,\"to \"\"a\"\",", "", "b\"", "2,c", '3,"d,e"\r', " "] * 1000
    found, arrays = cut_records(lines, 0, [2500, 1])
    assert found == [(pieces._WHOLE, t) for t in ['1,"to ""a"",\n\nb"', "2,c", '3,"d,e"'] * 1000]
    assert arrays <= 6  # a few for each batch of lines, not some for each record


def test_carriage_returns_at_the_end():
    lines = ["a,b\r\r", '5" x\r\r', '"a', 'b"\r\r', '"u"\r\r', '"v"\r']
    assert [t for _, t in cut_records(lines, 0, [])[0]] == ["a,b", '5" x\r', '"a\nb"\r', '"u"\r', '"v"']


def test_text_that_is_not_utf8_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'a,b\n1,"x\xe9\ny"\n2,\xe9\n')
    with pytest.raises(Exception, match="(?i)utf-?8"):
        read_transactions(spark, str(tmp_path / "a.csv"), multiline=True).collect()
