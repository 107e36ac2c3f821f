"""Sources, extraction, text and time functions, closures, intents and streaming on small inputs."""

import json
from dataclasses import replace
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from annalist import cli, sinks
from annalist.functions.text import fuzzy_labels, jaro_winkler, title_match, word_match
from annalist.functions.time import century_bucket, century_floor, parse_time
from annalist.model import SCHEMAS, Model, empty_model, load, save
from annalist.operators import closure as graph
from annalist.operators.resolve import resolve_lines
from annalist.plans import library, registry
from annalist.plans.intent import Unsupported, answer
from annalist.scratch import shared_dir
from annalist.sources import dump, intents, tables
from annalist.streaming.ingest import Status, ingest


def entity(qid, kinds=("Q5",), dates=("+1900-01-02T00:00:00Z",), **more):
    claim = lambda p, kind, value: {"mainsnak": {"property": p, "datavalue": {"type": kind, "value": value}}}
    claims = {"P31": [claim("P31", "wikibase-entityid", {"id": k}) for k in kinds], "P569": [claim("P569", "time", {"time": d, "timezone": 0}) for d in dates]}
    return {"id": qid, "labels": {"en": {"value": f"label {qid}"}}, "descriptions": {}, "claims": claims, "sitelinks": {}} | more


def test_time_parsing(spark):
    raw = ["+1991-02-12T00:00:00Z", "-0044-00-00T00:00:00Z", "-13800000000-00-00T00:00:00Z", "+0000-00-00T00:00:00Z", None, "Q42", "+12345678901234567890-00-00T00:00:00Z"]
    df = spark.createDataFrame([(r,) for r in raw], "t string")
    got = [tuple(r) for r in df.select(*(v.alias(k) for k, v in parse_time(df.t).items())).collect()]
    assert got == [(1991, 2, 12, False), (-44, 0, 0, True), (-13800000000, 0, 0, True), (0, 0, 0, False), (None, None, None, None), (None, None, None, False), (None, 0, 0, False)]


def test_centuries(spark):
    df = spark.createDataFrame([(y,) for y in (1850, 1851, 1950, -50)], "y long")
    assert [tuple(r) for r in df.select(century_bucket(df.y), century_floor(df.y)).collect()] == [(1800, 1800), (1900, 1800), (2000, 1900), (0, -100)]


def test_text_matches(spark):
    df = spark.createDataFrame([("Russian Empire",), ("Prussia",), ("War and Peace",), (None,)], "l string")
    pick = lambda c: [r[0] for r in df.where(c).collect()]
    assert pick(word_match(df.l, "Russia")) == ["Russian Empire"]
    assert pick(title_match(df.l, "war peace")) == ["War and Peace"]
    assert [r[0] for r in fuzzy_labels(df.withColumnRenamed("l", "label"), "Empyre Russian").collect()] == ["Russian Empire"]


def test_jaro_winkler_as_duckdb():
    words = ["MARTHA", "MARHTA", "Beethoven", "Beethowen", "mahler", "Mahler", "Ä", "über", "uber", "abc", "abcd", "x"]
    for a in words:
        for b in words:
            assert jaro_winkler(a, b) == pytest.approx(duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0])


def test_extraction(spark):
    lines = ["[", json.dumps(entity("Q1", dates=("+1900-01-02T00:00:00Z",) * 2)) + ",", json.dumps(entity("Q2", kinds=("Q99",))), json.dumps(entity("Q3", dates=())), '{"broken', json.dumps(entity("Q4", labels=[], sitelinks=[])), "]"]
    good, bad = dump.parse_entities(spark.createDataFrame([(x,) for x in lines], "value string"))
    out = dump.extract(good)
    assert [r[0] for r in bad.collect()] == ['{"broken']
    assert sorted(r.qid for r in out["items"].collect()) == ["Q1", "Q4"]
    assert sorted(r.qid for r in out["items_not_used"].collect()) == ["Q2", "Q3"]
    assert [(r.qid, r.sitelinks) for r in out["sites"].collect()] == [("Q1", 0)]
    assert sorted((r.qid, r["class"], r.year) for r in out["events"].collect()) == [("Q1", "Q5", 1900), ("Q4", "Q5", 1900)]


def test_flat_sources(spark, tmp_path):
    (tmp_path / "v.csv").write_text('# note\nQ1;"a;b";"say ""x"""\nQ2;Piano #1\n')
    rows = tables.load_table(spark, "value_items", str(tmp_path / "v.csv")).orderBy("qid").collect()
    assert [tuple(r) for r in rows] == [("Q1", "a;b", 'say "x"'), ("Q2", "Piano #1", None)]
    (tmp_path / "i.csv").write_text("Q1;one;a; b;ru;odin;c;d\nQ2;two\n")
    rows = tables.read_items_tolerant(spark, str(tmp_path / "i.csv")).orderBy("qid").collect()
    assert tuple(rows[0]) == ("Q1", "one", "a; b", "odin", "c;d") and rows[1].label == "two"
    (tmp_path / "p.json").write_text('{"P569": ["birth", "d"], "P1": ["x"]}')
    props = {r.pid: (r.label, r.description, r.kind) for r in tables.read_properties(spark, str(tmp_path / "p.json")).collect()}
    assert props == {"P569": ("birth", "d", "date"), "P1": ("x", None, "other")}
    assert tables.load_table(spark, "classes", str(tmp_path / "none.csv")).count() == 0


def test_closure_with_cycle_and_areas(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("y", "x")], "child string, parent string")
    seeds = spark.createDataFrame([("a", "a"), ("x", "x")], "qid string, root string")
    assert sorted(tuple(r) for r in graph.closure(edges, seeds).collect()) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    used = spark.createDataFrame([("b", "bee", 3), ("y", "why", 2)], "qid string, label string, people long")
    none = spark.createDataFrame([], "item string, class string")
    areas = graph.occupation_areas(edges, none, used, seeds=[("art", "a"), ("music", "a")], excluded=[("x", "x")])
    assert [tuple(r) for r in areas.collect()] == [("b", "bee", "art|music", 3)]


def test_resolve_lines(spark):
    lines = spark.createDataFrame([("Q1",), ("Q2",)], "line string")
    assert sorted(r[0] for r in resolve_lines(lines, spark.createDataFrame([("Q1", ";x")], "qid string, rest string")).collect()) == ["Q1;x", "Q2"]


def test_empty_model_answers_nothing(spark, tmp_path):
    save(empty_model(spark), str(tmp_path / "m"))
    model = load(spark, str(tmp_path / "m"))
    assert set(SCHEMAS) == set(Model.__dataclass_fields__)
    assert library.events_of_period(model, 1, 2, "event").count() == 0
    assert answer(model, {"target_type": "person", "filters": {"name": "x"}}).rows.count() == 0


def test_unsupported_intents(spark):
    model = empty_model(spark)
    for bad in ("x", {"target_type": "thing"}, {"target_type": "work", "filters": {"domain": "cooking"}}, {"target_type": "person", "filters": {"compare_entities": {"entities": ["a", "b"], "aspect": "age", "relation": "older"}}}, {"target_type": "work", "filters": {}}, {"target_type": "event", "filters": {"related_entity": {"relation": "creates", "entity_mention": "x"}}}, {"target_type": "person", "filters": {"compare_entities": {"entities": ["a"]}}}):
        with pytest.raises(Unsupported):
            answer(model, bad)
    assert answer(model, {"target_type": "work", "filters": {"domain": "cooking", "name": "x"}}).dropped == ["domain=cooking"]
    assert answer(model, {"target_type": "person", "filters": {"domain": "cooking"}}).dropped == ["domain=cooking"]


def items_of(spark, rows):
    return spark.createDataFrame([(q, en, None, ru, None) for q, en, ru in rows], SCHEMAS["items"])


def test_labels_fall_back_to_the_other_language(spark):
    lives = [(q, "P569", None, None, 1700 + i, None, None, False, None, None, None) for i, q in enumerate(("Q1", "Q2"))] + [(q, "P570", None, None, 1750 + 2 * i, None, None, False, None, None, None) for i, q in enumerate(("Q1", "Q2"))]
    model = replace(empty_model(spark), items=items_of(spark, [("Q1", None, "Ivan Petrov"), ("Q2", "Jon Smith", "x")]), events=spark.createDataFrame(lives, SCHEMAS["events"]), item_classes=spark.createDataFrame([("Q1", "K"), ("Q2", "K")], SCHEMAS["item_classes"]), classes=spark.createDataFrame([("K", "k", None, "person")], SCHEMAS["classes"]))
    asked = {"target_type": "person", "filters": {"name": "Petrov"}}
    assert [tuple(r) for r in answer(model, asked).rows.collect()] == [("Ivan Petrov", 1700, 1750, None)]
    assert answer(model, {"target_type": "work", "filters": {"name": "Petrov"}}).rows.columns == ["work", "year", "sitelinks"]
    duel = {"entities": ["Petrov", "Jon Smith"], "aspect": "age", "relation": "fewer"}
    assert answer(model, {"target_type": "person", "filters": {"compare_entities": duel}}).rows.first().asDict() == {"entity_1": "Ivan Petrov", "entity_2": "Jon Smith", "age_1": 50, "age_2": 51, "answer": True}


def test_fuzzy_match_below_the_default_threshold(spark):
    words = ["abcdefghijk", "abcdef", "abc", "xbcde", "zzzzz", "abcdeabcdeabcdeabcde"]
    df = spark.createDataFrame([(w,) for w in words], "label string")
    for threshold in (0.95, 0.9, 0.8, 0.6):
        got = {r[0] for r in fuzzy_labels(df, "abcde", threshold=threshold).collect()}
        assert got == {w for w in words if jaro_winkler("abcde", w) >= threshold}


def test_training_step_and_command_line(spark, tmp_path, capsys):
    save(replace(empty_model(spark), items=items_of(spark, [("Q1", "one", None)])), str(tmp_path / "m"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"sentence": "s", "intent": {"target_type": "work", "filters": {"name": "one"}}}))
    (tmp_path / "in/b.json").write_text("no json")
    (tmp_path / "in/c.json").write_text(json.dumps({"target_type": "work", "filters": {}}))
    log = tmp_path / "log.jsonl"
    assert cli.main(["answer", str(tmp_path / "m"), "--folder", str(tmp_path / "in"), "--log", str(log)], spark) == 0
    done = [json.loads(x) for x in log.read_text().splitlines()]
    assert [(r["db_status"], r["row_count"], r["sql_source"], r["human_correct"]) for r in done] == [("success", 1, "composer", None), ("unavailable", None, None, None)]
    assert "Project" in done[0]["gold_sql"] and "no filter" in done[1]["db_error"]
    assert cli.main(["answer", str(tmp_path / "m"), "--intent", str(tmp_path / "in/a.json")], spark) == 0
    assert '{"work":"one"}' in capsys.readouterr().out
    (tmp_path / "e.csv").write_text("Q13418848;Q13418847\n")
    (tmp_path / "l.csv").write_text("Q13418848;sub;text\n")
    assert cli.main(["closure", str(tmp_path / "e.csv"), str(tmp_path / "l.csv"), str(tmp_path / "out")], spark) == 0
    assert ["Q13418848", "sub", "text", "event"] in [list(r) for r in spark.read.csv(str(tmp_path / "out/classes"), sep=";").collect()]
    assert tables.selection(spark, str(tmp_path / "none"), ("a", "b"))[1] == -1
    (tmp_path / "sel.csv").write_text("# note\nQ1;x\n\nQ2\n")
    assert tables.selection(spark, str(tmp_path / "sel.csv"), ("a",))[1] == 2


def test_first_wins(spark, tmp_path):
    df = spark.createDataFrame([("a", "z", 1), ("a", "b", 2), ("c", "d", 1)], "k string, v string, n int")
    assert sorted(tuple(r) for r in sinks.first_wins(df, ["k"], str(tmp_path / "t"), "n").collect()) == [("a", "z", 1), ("c", "d", 1)]
    df.where("k = 'c'").write.parquet(str(tmp_path / "t"))
    assert [tuple(r) for r in sinks.first_wins(df, ["k"], str(tmp_path / "t")).collect()] == [("a", "b", 2)]


def test_intents_are_cut_only_by_the_composers_limit(spark):
    model = empty_model(spark)
    model = replace(model, items=spark.createDataFrame([(f"Q{i}", "same") for i in range(250)], "qid string, label string").select(*(F.col(f.name) if f.name in ("qid", "label") else F.lit(None).cast(f.dataType).alias(f.name) for f in model.items.schema)))
    asked = {"target_type": "work", "filters": {"name": "same"}}
    assert answer(model, asked).rows.count() == 200
    assert answer(model, asked, registry.ALL).rows.count() == 250
    plan = answer(model, asked, registry.ALL).rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan


def test_find_json():
    assert intents.find_json('so: {"a": {"b": "}"}} end') == {"a": {"b": "}"}}
    assert intents.strip_fence("```sql\nselect 1\n```") == "select 1"


def test_streaming_ingest(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.json").write_text(json.dumps(entity("Q1")) + "\n")
    assert ingest(spark, src + "/missing", out, ck) == Status.ERROR
    assert ingest(spark, src, out, ck) == Status.DONE
    assert spark.read.parquet(f"{out}/items").count() == 1
    # Another chunk: an item that was written before is not written again.
    (tmp_path / "src/b.json").write_text("\n".join(json.dumps(entity(q)) for q in ("Q1", "Q2")) + "\n")
    assert ingest(spark, src, out, ck) == Status.DONE
    assert sorted(r.qid for r in spark.read.parquet(f"{out}/items").collect()) == ["Q1", "Q2"]


def test_streaming_ingest_inside_one_file_and_after_an_error(spark, tmp_path, monkeypatch):
    src, out, ck = (str(tmp_path / x) for x in ("dump.json", "out", "ck"))
    (tmp_path / "dump.json").write_text("\n".join(json.dumps(entity(f"Q{i}")) for i in range(5)) + "\n")
    monkeypatch.setattr(dump, "extract", None)
    assert ingest(spark, src, out, ck, items_per_chunk=2) == Status.ERROR
    assert ingest(spark, src, out, ck, items_per_chunk=2, max_chunks=1) == Status.ERROR
    monkeypatch.undo()
    assert ingest(spark, src, out, ck, items_per_chunk=2, max_chunks=1) == Status.MORE
    assert spark.read.parquet(f"{out}/items").count() < 5
    assert ingest(spark, src, out, ck, items_per_chunk=2) == Status.DONE
    assert sorted(r.qid for r in spark.read.parquet(f"{out}/items").collect()) == [f"Q{i}" for i in range(5)]


def test_ingest_leaves_no_intermediate_tables(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.createDataFrame([(json.dumps(entity(f"Q{i}")),) for i in range(4)], "value string").coalesce(1).write.text(src)
    held = set(Path(shared_dir(spark)).iterdir())
    assert ingest(spark, src, out, ck) == Status.DONE
    assert spark.read.parquet(out + "/items").count() == 4
    assert set(Path(shared_dir(spark)).iterdir()) == held


def test_closure_of_a_long_chain_with_a_cycle(spark):
    edges = spark.createDataFrame([(f"N{i + 1}", f"N{i}") for i in range(6)] + [("N2", "N5"), ("N1", "N6")], "child string, parent string")
    seeds = spark.createDataFrame([("N0", "N0"), ("N4", "N4"), ("X", "X"), ("N0", "N0")], "qid string, root string")
    got = sorted((r.root, r.qid) for r in graph.closure(edges, seeds).collect())
    assert got == sorted([("N0", f"N{i}") for i in range(7)] + [("N4", f"N{i}") for i in range(1, 7)] + [("X", "X")])
    assert graph.closure(edges, seeds.limit(0)).count() == 0
