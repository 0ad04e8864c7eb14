import csv
import io
import json
import pathlib
import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from tomeweave.operators.artefacts import image_ext
from tomeweave.session import checkpoint_folder
from tomeweave.sources import lists, stores


def entries(found):
    return [(r["isbn13"], r["row"], r["label"]) for r in found.entries.orderBy("row").collect()]


def problems(found):
    return [(r["row"], r["reason"]) for r in found.problems.orderBy("row").collect()]


def write(tmp_path, content, name="books.csv"):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
    return str(path)


def test_single_column_with_header_and_bad_row(spark, tmp_path):
    found = lists.read_identifier_list(spark, write(tmp_path, "Isbn-13\n9780821716595\nnonsense\n9780312954154\n"))
    assert entries(found) == [("9780821716595", 2, None), ("9780312954154", 4, None)]
    assert problems(found)[0][0] == 3 and found.summary.first().asDict() == {"entries": 2, "duplicates": 0, "skipped": 1}


def test_both_spellings_of_one_book(spark, tmp_path):
    found = lists.read_identifier_list(spark, write(tmp_path, "0143127551\n9780143127550\n0062316095\n"))
    assert [e[0] for e in entries(found)] == ["9780143127550", "9780062316097"] and found.summary.first()["duplicates"] == 1


def test_bom_comment_blank_and_semicolons(spark, tmp_path):
    found = lists.read_identifier_list(spark, write(tmp_path, "﻿Title;Isbn-13\n# a comment\n\nEat Pray Love;9780143127550\n"))
    assert entries(found) == [("9780143127550", 4, "Eat Pray Love")]


def test_header_that_lies(spark, tmp_path):
    found = lists.read_identifier_list(spark, write(tmp_path, "isbn,code\nnot-an-isbn,9780143127550\n"))
    assert [e[0] for e in entries(found)] == ["9780143127550"]


def test_windows_code_page_open_quote_and_empty_list(spark, tmp_path):
    found = lists.read_identifier_list(spark, write(tmp_path, "Title,ISBN\nCaf\xe9,9780143127550\n\"open,9780062316097\n".encode("cp1252")))
    assert entries(found) == [("9780143127550", 2, "Café")] and problems(found) == [(3, "unparseable (open quote)")]
    assert found.summary.first().asDict() == {"entries": 1, "duplicates": 0, "skipped": 1}
    nothing = lists.read_identifier_list(spark, write(tmp_path, "\n", "none.csv"))
    assert entries(nothing) == [] and problems(nothing) == [(0, "the list is empty")] and nothing.summary.first()["skipped"] == 1
    only_header = lists.read_identifier_list(spark, write(tmp_path, "Isbn\n", "head.csv"))
    assert problems(only_header) == [(0, "the list has no data rows")]


def test_quoted_cells_over_lines_and_rows_of_any_width(spark, tmp_path):
    content = 'Title,ISBN\n"two\nlines, ""quoted""",9780143127550\nx,9780312954154,"a\n\nb",y\n"runaway,1\nz,9780821716595\n'
    found = lists.read_identifier_list(spark, write(tmp_path, content))
    assert entries(found) == [("9780143127550", 3, 'two\nlines, "quoted"'), ("9780312954154", 6, "x"), ("9780821716595", 8, "z")]
    assert problems(found) == [(7, "unparseable (open quote)")]
    wide = lists.read_identifier_list(spark, write(tmp_path, "9780143127550\n" * 250 + ",x\n", "wide.csv"))
    assert problems(wide) == [(251, "column 1 is empty")] and wide.summary.first().asDict() == {"entries": 1, "duplicates": 249, "skipped": 1}


def test_records_equal_the_standard_reader(spark, tmp_path):
    rng, lists_of = random.Random(5), {}
    for trial in range(40):
        d = rng.choice(";,|\t")
        rows = []
        for _ in range(rng.randrange(1, 60)):
            cells = ["".join(rng.choice(['"', '""', "\n", d, "a", "b c", "é", '"' + d, d + '"', ""]) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 5))]
            rows.append(d.join('"' + c.replace('"', '""') + '"' if rng.random() < 0.5 else c.replace("\n", "") for c in cells))
        # what closes every quote that is left open
        text = "\n".join(rows) + "\n"
        want = list(csv.reader(io.StringIO(text, newline=""), delimiter=d))
        if text.count('"') % 2 or list(csv.reader(io.StringIO(text + "end", newline=""), delimiter=d))[-1] != ["end"]:
            continue
        path = write(tmp_path, text, f"r{trial}.csv")
        lists_of.setdefault(d, []).append((path, [[c.strip(" ") for c in r] for r in want if r]))
    assert sum(map(len, lists_of.values())) > 10
    old = lists.BLOCK_LINES
    lists.BLOCK_LINES = 4
    try:
        for d, files in lists_of.items():
            lines = lists.read_lines(spark, [p for p, _ in files])
            got = lists.join_quoted_lines(lines, d).where("value <> '' or open_quote").select("file", "row", lists.cells_of(F.col("value"), d).alias("cells"), "open_quote").orderBy("file", "row").collect()
            for path, want in files:
                assert [r["cells"] for r in got if r["file"].endswith(path)] == want
                assert not any(r["open_quote"] for r in got)
    finally:
        lists.BLOCK_LINES = old


def test_a_cell_of_any_length_over_many_blocks(spark, tmp_path):
    long = "\n".join(f"line {i}, with \"\"marks\"\" and; signs" for i in range(5000))
    path = write(tmp_path, f'ISBN,Title\n9780143127550,"{long}"\n9780312954154,"x"\n"never closed,9780062316097\n9780821716595,last\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        found = lists.read_identifier_list(spark, path)
        assert [(e[0], e[1]) for e in entries(found)] == [("9780143127550", 5001), ("9780312954154", 5002), ("9780821716595", 5004)]
        assert entries(found)[0][2] == long.replace('""', '"') and problems(found) == [(5003, "unparseable (open quote)")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_decoding_without_a_false_alarm(spark, tmp_path):
    for content, want in (("9780143127550,Caf\u00e9 \ufffd\n".encode(), "Café \ufffd"), ("9780143127550,Caf\u00e9 \u201cx\u201d\n".encode("cp1252"), "Café “x”"),
                          (b"9780143127550,Caf\xe9 \x81\x93\n", "Caf\xe9 \x81\x93"), ("\ufeff9780143127550,Z\u00fcrich\n".encode(), "Zürich")):
        path = write(tmp_path, content, f"{len(want)}{want[-1]!a}.csv".replace("\\", ""))
        assert [r["value"] for r in lists.read_with_fallback(spark, path).collect()] == ["9780143127550," + want]


def test_delimiters_by_their_constancy(spark, tmp_path):
    for content, want in (("a;b\nc;d, e\n", ";"), ("a|b|c\n1|2|3\n", "|"), ("one\ntwo\n", ","), ('"a,b";c\n"d,e";f\n', ";"), ("a\tb\n", "\t"), ("a,b;c\n", ",")):
        assert lists.delimiter_of(lists.read_lines(spark, write(tmp_path, content, f"{ord(want)}{len(content)}.csv"))).first()[0] == want


def test_line_numbers_over_many_blocks(spark, tmp_path):
    path = write(tmp_path, "".join(f"line {i}\n" for i in range(1, 4001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = lists.read_lines(spark, path)
        assert got.where(F.concat(F.lit("line "), F.col("row").cast("string")) != F.col("value")).count() == 0 and got.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_metadata_arrays(spark, tmp_path):
    write(tmp_path, json.dumps([{"isbn13": "1", "title": "A", "authors": ["x"]}, 5, "no", {"isbn13": "2"}]), "amazon_metadata.json")
    write(tmp_path, json.dumps({"isbn13": "3"}), "kobo_metadata.json")
    write(tmp_path, '[{"isbn13": "4"}', "audible_metadata.json")
    got = stores.record_fields(stores.read_metadata_arrays(spark, str(tmp_path / "*_metadata.json"))).orderBy("isbn13").collect()
    assert [(r["source"], r["isbn13"], r["title"]) for r in got] == [("amazon", "1", "A"), ("amazon", "2", None), ("kobo", "3", None)] and got[0]["authors"] == ["x"]


def test_arrays_of_any_shape_equal_the_standard_parser(spark, tmp_path):
    rng, want = random.Random(4), []
    odd = ["a}b", "{", '"', "\\", 'x\\"}', "[]", "é}", "", None, 5, 1.5, True, "},{", "\n}"]

    def value(deep):
        if deep > 3 or rng.random() < 0.4:
            return rng.choice(odd)
        if rng.random() < 0.4:
            return [value(deep + 1) for _ in range(rng.randrange(4))]
        return {rng.choice('ab}"{'): value(deep + 1) for _ in range(rng.randrange(4))}

    for i in range(48):
        items = [{"isbn13": f"{i}-{j}", "v": value(0)} if rng.random() < 0.7 else value(0) for j in range(rng.randrange(30))]
        if i % 8 == 3:
            items = {"isbn13": str(i), "v": value(0)}
        text = json.dumps(items, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        if i % 6 == 5:
            at = rng.randrange(len(text))
            text = rng.choice([text[:at], text + "]", text + "x", text.replace("}", "}}", 1), "[," + text[1:], text[:-1] + ",,{}]", text + "\n "])
        write(tmp_path, text, f"s{i}_metadata.json")
        try:
            body = json.loads(text)
        except ValueError:
            continue
        want += [(f"s{i}", p, json.dumps(x, sort_keys=True)) for p, x in enumerate(body if isinstance(body, list) else [body]) if isinstance(x, dict)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = stores.read_metadata_arrays(spark, str(tmp_path / "*_metadata.json")).selectExpr("source", "pos", "to_json(record) AS r").collect()
        assert sorted((r["source"], r["pos"], json.dumps(json.loads(r["r"]), sort_keys=True)) for r in rows) == sorted(want) and len(want) > 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ledgers_round_trip(spark, tmp_path):
    write(tmp_path, "1 2\n2\n", "kobo_no_data.txt")
    write(tmp_path, "3\n", "amazon_incomplete.txt")
    found = stores.read_ledgers(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [("amazon", "incomplete", "3"), ("kobo", "no_data", "1"), ("kobo", "no_data", "2")]
    stores.write_ledgers(found, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "kind=no_data" / "source=kobo")).count() == 2
    assert sorted(map(tuple, stores.read_written_ledgers(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, found.collect()))


def test_snapshots_replace_without_touching_their_input(spark, tmp_path):
    root = str(tmp_path / "records")
    first = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "source string, isbn13 string, title string")
    assert stores.read_snapshot(spark, root) is None and stores.replace_snapshot(first, root) == 0
    changed = stores.read_snapshot(spark, root).withColumn("title", F.upper("title"))
    assert stores.replace_snapshot(changed, root) == 1
    assert sorted(r["title"] for r in stores.read_snapshot(spark, root).collect()) == ["X", "Y"]


def test_image_types_from_files(spark, tmp_path):
    write(tmp_path, b"\x89PNG\r\n\x1a\n" + b"x" * 600, "a.jpg")
    write(tmp_path, b"zz", "b.PNG")
    images = stores.read_images(spark, str(tmp_path))
    got = {r["url"][-5:]: r["e"] for r in images.select("url", image_ext(F.col("content"), F.lit(None).cast("string"), F.col("url")).alias("e")).collect()}
    assert got == {"a.jpg"[-5:]: "png", "b.PNG"[-5:]: "png"}


def test_upserts_write_only_touched_buckets_and_can_run_again(spark, tmp_path):
    from tomeweave.streaming import incremental

    root = str(tmp_path / "keyed")
    apply = incremental.upsert_batches(spark, root, ["k"], ["ts"], buckets=4)
    make = lambda *rows: spark.createDataFrame(list(rows), "k string, ts bigint, v string")
    batches = [make(*[(f"k{i}", 1, "old") for i in range(20)]), make(("k3", 2, "new"), ("k3", 3, "newer"), ("k99", 2, "new")), make(("k99", 5, "last"))]
    for number in (0, 1, 1, 2, 2):
        apply(batches[number], number)
    held = incremental._manifest(spark, root, 2)
    got = {(r["k"], r["ts"], r["v"]) for r in incremental.stored(spark, root, held, batches[0]).collect()}
    assert got == {(f"k{i}", 1, "old") for i in range(20) if i != 3} | {("k3", 3, "newer"), ("k99", 5, "last")}
    assert len([b for b in held.values() if b == 2]) == 1 and 0 in held.values()


def test_texts_of_arrays_are_dealt_to_their_files_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "arrays")
    rows = spark.range(40).selectExpr("concat('s', id % 3) AS source", "39 - id AS pos", "to_json(named_struct('isbn13', string(id), 'text', 'a } b')) AS record")
    monkeypatch.setattr(type(rows), "repartition", lambda *a: pytest.fail("a second shuffle"))
    stores.write_metadata_arrays(rows, path, parts=2)
    monkeypatch.undo()
    files = sorted((tmp_path / "arrays").glob("source=*/part=*/*.txt"))
    assert len(files) == 6
    held = [json.loads(f.read_text()) for f in files]
    assert sum(map(len, held)) == 40 and all([int(r["isbn13"]) for r in h] == sorted((int(r["isbn13"]) for r in h), reverse=True) for h in held)


def disk_used(spark, *folders):
    """Bytes of shuffles and spills, and of the folders' files."""
    held = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(held.apply(i).length() for i in range(held.size())) + sum(p.stat().st_size for folder in folders for p in folder.rglob("*") if p.is_file())


def test_texts_of_arrays_are_not_shuffled_or_kept_by_their_reader(spark, tmp_path):
    rng = random.Random(8)
    texts = [rng.randbytes(10000).hex() + rng.choice(["", "}", '"}{"', "\\"]) for _ in range(300)]
    write(tmp_path, json.dumps([{"isbn13": str(i), "text": t} for i, t in enumerate(texts)]), "kobo_metadata.json")
    kept = pathlib.Path(urllib.parse.urlparse(checkpoint_folder(spark)).path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        before = disk_used(spark, kept)
        got = stores.read_metadata_arrays(spark, str(tmp_path / "*_metadata.json")).selectExpr("pos", "record:text::string AS t").collect()
        assert [r["t"] for r in sorted(got, key=lambda r: r["pos"])] == texts
        # an element that two splits share is all they have to bring together
        assert disk_used(spark, kept) - before < sum(map(len, texts)) / 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_elements_over_many_splits_and_files_that_do_not_end(spark, tmp_path):
    long = {"isbn13": "9", "v": [{"w": "}" * 5}] * 60}
    write(tmp_path, "\ufeff" + json.dumps([1, 2, long, "x", [3], {"isbn13": "8"}, 4, {"isbn13": "7"}]), "kobo_metadata.json")
    write(tmp_path, json.dumps(long), "amazon_metadata.json")
    write(tmp_path, json.dumps([{"isbn13": "6"}] * 60)[:-1], "audible_metadata.json")
    write(tmp_path, json.dumps([{"isbn13": "5"}] * 30 + [{"isbn13": "4"}]).replace("}, {", "}, 0x, {", 1), "bookbub_metadata.json")
    write(tmp_path, b'[{"isbn13": "3", "v": "a\xffb"}]', "goodreads_metadata.json")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        rows = stores.read_metadata_arrays(spark, str(tmp_path / "*_metadata.json")).selectExpr("source", "pos", "isbn13", "to_json(record) AS r").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(tuple(r)[:3] for r in rows) == [("amazon", 0, "9"), ("goodreads", 0, "3"), ("kobo", 2, "9"), ("kobo", 5, "8"), ("kobo", 7, "7")]
    assert all(json.loads(r["r"]) == long for r in rows if r["isbn13"] == "9")
