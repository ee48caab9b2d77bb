"""Operators on small frames, against plain Python where the rule is a loop."""

import http.server
import json
import random
import re
import threading
import urllib.parse
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from termlens.functions import text as tx
from termlens.operators import clustering, evaluate, extraction, gaps, grounding, trends
from termlens.plans import domain, queries, views
from termlens.sources import catalogs, files, rest, sinks, tables
from termlens.streaming import incremental


def found(spark, docs, terms, mode):
    rows = extraction.extract(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), terms, mode=mode).collect()
    return {i: {r.term for r in rows if r.doc_id == i} for i in range(len(docs))}


def test_extraction_modes_differ_on_overlap(spark):
    docs = ["Microsoft SQL Server and Amazon Web Services", "5 years of C++ and Python. Familiar with Docker and Git workflows.", "", None]
    terms = ["SQL", "SQL Server", "Microsoft SQL Server", "Amazon Web Services", "C", "C++", "Python", "Docker", "Git"]
    every, longest = found(spark, docs, terms, "all"), found(spark, docs, terms, "longest")
    assert every[0] == {"sql", "sql server", "microsoft sql server", "amazon web services"}
    assert longest[0] == {"microsoft sql server", "amazon web services"}
    assert every[1] == {"c", "c++", "python", "docker", "git"} and longest[1] == {"c++", "python", "docker", "git"}
    assert every[2] == every[3] == longest[2] == set()


def test_extraction_equals_plain_patterns(spark):
    rng = random.Random(5)
    pool = ["a", "b", "c", "d", "c++", "é", ".net", "x_1"]
    terms = ["a", "a b", "b c", "c++", "d", "d a", ".net", "x_1", "c d a"]
    docs = [rng.choice(["", " "]).join(rng.choice([" ", " ", "  ", ", ", "\n"]) + rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    every, longest = found(spark, docs, terms, "all"), found(spark, docs, terms, "longest")
    pattern = re.compile(tx.any_term_pattern(terms), re.ASCII)
    for i, doc in enumerate(docs):
        assert every[i] == {t for t in terms if re.search(tx.term_pattern(t), doc, re.ASCII)}, doc
        assert longest[i] == {tx.normalize_py(m[1]) for m in pattern.finditer(doc)}, doc


def test_extraction_survives_a_long_text(spark):
    assert found(spark, ["ab cd " * 60_000], ["ab cd", "ab"], "all")[0] == {"ab cd", "ab"}


def test_rates_keep_pairs_without_coverage(spark):
    totals = spark.createDataFrame([("p", 4), ("q", 2), ("none", 0)], "program string, n_courses long")
    demand = spark.createDataFrame([(1, "python", 50), (2, "design", 60), (3, "go", 9)], "skill_id long, name string, demand_count long")
    skills = demand.select("skill_id", "name")
    n = spark.createDataFrame([(100,)], "n_postings long")
    cover = spark.createDataFrame([("p", 1, 2)], "program string, skill_id long, n long")
    rows = gaps.rates(cover, gaps.relevant(demand.drop("name"), skills), totals, n).collect()
    assert {(r.program, r.skill_id, r.coverage_rate, r.demand_rate) for r in rows} == {("p", 1, 0.5, 0.5), ("q", 1, 0.0, 0.5)}


def test_recommendation_tiers_and_ties(spark):
    rows = [("p", i, f"s{i}", 0.0, 0.5, 0.5) for i in range(12)]
    g = spark.createDataFrame(rows, "program string, skill_id long, name string, coverage_rate double, demand_rate double, gap_value double")
    t = spark.createDataFrame([(11, "rising"), (0, "falling")], "skill_id long, trend_label string")
    out = gaps.recommendations(g, t).orderBy("rank").collect()
    assert [r.skill_id for r in out] == [11, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r.priority_tier for r in out] == ["high"] * 3 + ["medium"] * 4 + ["low"] * 3
    assert out[0].priority_score == 0.75 and out[1].trend_label == "no trend data"


def test_trends(spark):
    weeks = [f"2024-W{w:02d}" for w in range(1, 7)]
    events = [(f"{w}-{i}", "up" if i < 10 * k + 5 else "flat" if i >= 90 else "rest", w) for k, w in enumerate(weeks) for i in range(100 if k else 99)]
    df = spark.createDataFrame(events, "id string, skill string, week string")
    rates = trends.dense_rates(trends.weekly(df, "id", "skill", "week"), trends.kept_weeks(df, "id", "week"))
    out = {r.skill: r for r in trends.regression(rates).collect()}
    assert out["up"].weeks_covered == 5 and out["up"].trend_label == "rising" and out["up"].slope == pytest.approx(0.1)
    assert out["flat"].slope == 0 and out["flat"].p_value == 1 and out["flat"].r_squared == 0 and out["flat"].trend_label == "no clear trend"
    assert out["up"].first_half_rate == pytest.approx(0.2) and out["up"].second_half_rate == pytest.approx(0.45)
    assert trends.regression(rates.where("idx < 4")).count() == 0


def test_grounding(spark):
    known = grounding.lookup(spark.createDataFrame([(1, "Python"), (2, "python "), (3, "Machine Learning"), (4, "SQL")], "pos long, term string"))
    answers = spark.createDataFrame([(1, "- pythn\n1. Machine Learnin\n* zzzz"), (2, "None"), (3, None), (4, "PYTHON\npython")], "item_id long, answer string")
    out = {r.item_id: r for r in grounding.grounded(answers, known).collect()}
    assert out[1].terms == ["python ", "Machine Learning"] and out[1].dropped == 1
    assert out[2].terms == [] and out[2].dropped == 0 and out[3].terms == [] and out[4].terms == ["python "]


def test_every_line_of_a_turn_is_grounded(spark, tmp_path):
    spark.createDataFrame([(1, "data python learning")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns = [(1, 0, "pythn\n- data\nzzzzzz\nLearning"), (1, 1, "qqqq\ndata"), (2, 0, None)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.item_id: (r.n_terms, r.dropped) for r in queries.QUERIES["grounded_answers"](spark, str(tmp_path)).collect()}
    assert out == {"1-0": (3, 1), "1-1": (1, 1), "2-0": (0, 0)}


def test_nearest_other_equals_brute_force(spark, tmp_path):
    import numpy as np

    x = np.random.default_rng(4).normal(0, 1, (120, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(120, [0.0] * 8), (121, None)], "vec_id long, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    scores = u @ u.T - 9 * np.eye(120)
    want = {i: int(scores[i].argmax()) for i in range(120) if scores[i].max() >= 0.3}
    found = grounding.nearest_other(rows.selectExpr("vec_id as id", "embedding as vector"), 0.3, block=50)
    assert {r.item_id: r.match_id for r in found.collect()} == want
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.item_id: r.match_id for r in queries.QUERIES["cosine_nearest"](spark, str(tmp_path)).collect()} == want


def test_short_words_and_other_letters_are_kept(spark, tmp_path):
    spark.createDataFrame([(1, "data learning")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "dat learnin zq")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "Größe und Maß..."), (2, "Plain.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.raw: r.term for r in queries.QUERIES["fuzzy_ground"](spark, str(tmp_path)).collect()} == {"dat": "data", "learnin": "learning", "zq": None}
    assert {r.doc_id: r.title for r in queries.QUERIES["title_clean_all"](spark, str(tmp_path)).collect()} == {1: "Größe und Maß", 2: "Plain"}


def test_asking_isolates_failures(spark):
    def client():
        def call(prompt):
            if "bad" in prompt:
                raise ValueError("no")
            return prompt.upper()

        return call

    items = spark.createDataFrame([(1, "ok"), (2, "bad")], "item_id long, prompt string")
    out = grounding.ask(items, client)
    assert {(r.item_id, r.answer, r.call_succeeded) for r in out.collect()} == {(1, "OK", True), (2, None, False)}
    assert [r.item_id for r in grounding.still_open(items, out).collect()] == [2]


def test_capacity_sample_equals_the_greedy_loop(spark):
    rng = random.Random(1)
    titles = [" ".join(rng.sample(["alpha", "beta", "gamma", "x"], 2)) for _ in range(200)]
    room, want = {"alpha": 20, "beta": 20, "gamma": 20}, {}
    for i, t in enumerate(titles):
        for c in ("alpha", "beta", "gamma"):
            if c in t and room[c]:
                room[c] -= 1
                want[i] = c
                break
    df = spark.createDataFrame(list(enumerate(titles)), "pos long, title string")
    got = {r.pos: r.category for r in clustering.capacity_sample(df, "title", "pos", ("alpha", "beta", "gamma"), 20).collect()}
    assert got == want


def test_silhouettes_agree(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (15, 4)), rng.normal(4, 1, (15, 4)), [[50.0] * 4]])
    labels = np.array([0] * 15 + [1] * 15 + [2])
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, labels))], "id long, vector array<double>, cluster int")
    want = pytest.approx(clustering.silhouette_blocks(x, labels, 7), abs=1e-7)
    assert clustering.silhouette(df).first()[0] == want and clustering.silhouette(df, block=5).first()[0] == want
    assert clustering.silhouette(df.limit(0)).first()[0] is None
    k, score, found = clustering.pick_k(df.select("id", "vector"), range(2, 4), 2)
    assert k in (2, 3) and score > 0.5 and found.count() == 31


def test_micro_metrics(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, term string")
    p = spark.createDataFrame([(1, "a"), (2, "x"), (2, "x")], "id long, term string")
    r = evaluate.micro(t, p, ["id", "term"]).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 2) and r.precision == 0.5 and r.recall == pytest.approx(1 / 3) and r.f1 == pytest.approx(0.4)
    r = evaluate.micro(t.limit(0), p.limit(0), ["id", "term"]).first()
    assert (r.tp, r.precision, r.recall, r.f1) == (0, 0.0, 0.0, 0.0)
    assert [x.id for x in evaluate.missing(t, p.where("id = 1"), "id").collect()] == [2]


def test_catalog_layouts():
    def rows(layout, html):
        return list(catalogs.LAYOUTS[layout](catalogs.Page(html)))

    assert rows("name_code", "<p><b>Deep Learning (CS 7643)</b> - Nets.<br>More. <strong>Next (CS 1000)</strong> B</p>") == [("CS 7643", "Deep Learning", "Nets. More."), ("CS 1000", "Next", "B")]
    assert rows("code_item", "<b>CSE 230: Assembly</b><ul><li>Low <i>level</i>.</li></ul>") == [("CSE 230", "Assembly", "Low level .")]
    leaf = "<p><strong>CS 1800. Discrete Structures. (4 Hours)</strong></p><p>Prerequisite(s): none</p><p>Logic.</p><p><strong>CMSC401 Algorithms (3 Credits)</strong></p><p><strong>CS 2 No</strong></p>"
    assert rows("leaf", leaf)[:2] == [("CS 1800", "Discrete Structures", "Logic."), ("CMSC401", "Algorithms", "CS 2 No")]
    assert rows("list_item", "<ul><li><b>CAS CS 511: Formal Methods</b> - Proofs.</li></ul>") == [("CAS CS 511", "Formal Methods", "Proofs.")]
    assert rows("dashed", "<p><b>COMP SCI/L I S 102 — INTRO TO AI</b></p><p>3 credits.</p><p>Search.</p>") == [("COMP SCI 102", "Intro To Ai", "Search.")]
    assert rows("credits", "<p><b>CSE 546 Machine Learning (4)</b> Models. View course details in MyPlan: CSE 546</p>") == [("CSE 546", "Machine Learning", "Models.")]
    plain = "EECS 545. Machine Learning (CSE)\nPrerequisite: a long line that is only a label of the course\nKernels and more. CourseProfile (ATLAS)\nEECS 1. x\nEECS 281. Data\nshort"
    assert rows("plain_dot", plain) == [("EECS 545", "Machine Learning (CSE)", "Kernels and more."), ("EECS 281", "Data", "short")]


def test_catalog_failures_are_rows(spark):
    pages = spark.createDataFrame([("p", "code_item", "<b>CSE 230: A</b><li>one</li><b>CSE 230: A</b><li>longer</li>"), ("q", "no such layout", "x"), ("r", "leaf", None)], "program string, layout string, html string")
    out = catalogs.courses(pages)
    assert out.where("error is not null").count() == 2
    assert [tuple(r) for r in catalogs.longest(out).collect()] == [("p", "CSE 230", "A", "longer")]
    catalogs.register(spark)
    pages.createOrReplaceTempView("pages_for_sql")
    assert spark.sql("SELECT c.course_code FROM pages_for_sql p, LATERAL read_catalog(p.html, p.layout) c WHERE p.program = 'p'").count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "x.csv").write_text('job_id,title\n1,"two\nlines, ""quoted"""\n2,\n')
    rows = files.csv(spark, str(tmp_path / "in" / "a" / "x.csv"), ["job_id", "title"]).collect()
    assert rows[0].title == 'two\nlines, "quoted"' and rows[1].title is None
    assert files.csv_tree(spark, str(tmp_path / "in")).select("source_name").distinct().first()[0] == "a_x.csv"
    jobs = [{"id": "7", "title": "Dev", "company": {"display_name": "X"}, "location": {"display_name": "Y", "area": ["Z"]}, "salary_min": 1.5, "created": "2024-01-01T00:00:00Z"}]
    for name, body in (("list.json", jobs), ("wrapped.json", {"results": jobs})):
        (tmp_path / name).write_text(json.dumps(body))
        r = files.postings_from_jobs(files.json_list_or_results(spark, str(tmp_path / name), files.JOB), "api").first()
        assert (r.posting_id, r.company, r.location, r.salary_min, r.posted_date, r.description) == ("7", "X", "Y", 1.5, "2024-01-01T00:00:00Z", None)
    assert tables.programs(spark).count() == 13
    spark.createDataFrame([(1, "a")], "k int, v string").createOrReplaceTempView("small_view")
    assert files.query(spark, "SELECT v FROM small_view WHERE k = ?", (1,)).first()[0] == "a"


def test_paged_rest(spark):
    book = {"u1": {"items": [{"code": "15-1", "title": "A"}], "next": "u2"}, "u2": {"items": [{"code": "15-2", "title": "B"}], "next": None}, "v": {"items": []}}

    def fetch(address, book=book):
        return book[address]

    got = rest.read_pages(spark, ["u1", "v"], "items", "code string, title string", fetch).collect()
    assert {(r.address, r.code) for r in got} == {("u1", "15-1"), ("u1", "15-2")}
    linked = {"a?limit=5": {"_links": {"skill": [{"t": 1}], "next": {"href": "b"}}}, "b": {"_links": {"skill": [{"t": 2}], "next": None}}, "c": {"_links": None}}

    def follow(address, book=linked):
        return book[address]

    keys = spark.createDataFrame([("a?limit=5",), ("c",), ("lost",), (None,)], "code string")
    got = rest.read_pages(spark, ["a?limit=5", "c"], "_links.skill", "t long", follow, next_key="_links.next.href").collect()
    assert sorted((r.address, r.t) for r in got) == [("a?limit=5", 1), ("a?limit=5", 2)]
    got = rest.read_details(keys, "code", "{key}", "_links.skill", "t long", lambda a, book=linked: book[urllib.parse.unquote(a)], "_links.next.href").collect()
    assert sorted((r.code, r.pos, r.t) for r in got if r.error is None) == [("a?limit=5", 0, 1), ("a?limit=5", 1, 2)]
    assert [(r.code, r.pos) for r in got if r.error] == [("lost", -1)]
    assert rest.with_parameters("https://x.org/s?b=1", {"a": "p q", "b": 2, "c": None}) == "https://x.org/s?b=1&a=p+q" and rest.with_parameters("u", {}) == "u"
    hits = spark.createDataFrame([("k2", "15-1252", "Dev"), ("k1", "15-1252", "Dev"), ("k1", "11-1", "No")], "keyword string, code string, title string")
    assert [tuple(r) for r in rest.occupations(hits).collect()] == [("15-1252", "Dev", ["k1", "k2"])]
    ex = "array<struct<title:string,hot_technology:boolean,in_demand:boolean>>"
    cats = spark.createDataFrame([(1, "Dev", 43, "DB", [("X", True, None), ("Y", None, None)], None), (2, "Ops", 43, "DB", [("X", False, True)], [("Z", True, True)])], f"pos int, occupation string, code long, title string, example {ex}, example_more {ex}")
    r = rest.technologies(cats).first()
    assert [(e.title, e.hot_technology, e.in_demand) for e in r.examples] == [("X", True, False), ("Y", False, False), ("Z", True, True)] and r.used_by_occupations == ["Dev", "Ops"]


def test_requests_carry_key_and_parameters():
    seen = []

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers["X-API-Key"]))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"row": [1]}')

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.handle_request, daemon=True).start()
    fetch = rest.with_key({"X-API-Key": "k"}, {"end": 20})
    assert fetch(f"http://127.0.0.1:{server.server_port}/s?keyword=a") == {"row": [1]}
    assert seen == [("/s?keyword=a&end=20", "k")]
    server.server_close()


def test_vocabulary_and_prefix(spark, tmp_path):
    skills = spark.createDataFrame([(1, "SQL", "skill"), (2, "sql", "knowledge")], "pos long, term string, type string")
    tools = spark.createDataFrame([(2, "Git "), (1, "git"), (3, "SQL")], "pos long, term string")
    assert [tuple(r) for r in extraction.vocabulary(skills, tools).orderBy("pos").collect()] == [(1, "SQL", "skill"), (2, "sql", "knowledge"), (3, "git", "technology"), (4, "SQL", "technology")]
    ids = spark.createDataFrame([("kaggle_kaggle_1",), ("x",), (None,)], "c string").select(tx.without_prefix(F.col("c")).alias("c"))
    assert {r.c for r in ids.collect()} == {"kaggle_1", "x", None}
    sinks.write_json(skills, f"{tmp_path}/out", without=("type", "absent"))
    assert set(spark.read.json(f"{tmp_path}/out").columns) == {"pos", "term"}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", None)], "k string, v string")
    new = spark.createDataFrame([("b", "2"), ("c", "3"), ("c", "4")], "k string, v string")
    assert {tuple(r) for r in sinks.insert_ignore(old, new, "k", "v").collect()} == {("a", "1"), ("b", None), ("c", "3")}
    assert {tuple(r) for r in sinks.keyed_update(old, new, "k", "v").collect()} == {("a", "1"), ("b", "2")}
    path = str(tmp_path / "slices")
    rows = spark.createDataFrame([(1, "course", "kw"), (2, "posting", "kw")], "id long, source_type string, method string")
    sinks.refresh_slices(rows, path)
    sinks.refresh_slices(rows.where("id = 1").withColumn("id", F.lit(9).cast("long")), path)
    assert sorted(r.id for r in sinks.table(spark, path).collect()) == [2, 9]


def test_views_on_small_tables(spark):
    labels = views.short_labels(tables.programs(spark)).collect()
    assert {r.label for r in labels} >= {"Georgia Tech", "Georgia Tech (2)", "Georgia Tech (3)", "U. Maryland", "U. Maryland (2)"}
    t = {"courses": spark.createDataFrame([(1, 1, "C1", "Intro", "Soft_ware")], "course_id long, program_id long, course_code string, course_name string, description string"), "programs": tables.programs(spark)}
    assert views.course_finder(t).count() == 0 and views.course_finder(t, text="SOFT").count() == 1 and views.course_finder(t, text="zzz").count() == 0
    top = spark.createDataFrame([(1, s, s) for s in range(3)], "cluster_id long, skill_id long, place int")
    mine = spark.createDataFrame([(0,)], "skill_id long")
    assert views.role_match(top, mine).first().score == pytest.approx(1 / 3)
    assert sorted((r.skill_id, r.have) for r in views.have_missing(top, mine, 1).collect()) == [(0, True), (1, False), (2, False)]


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2023, 12, 25)
    rows = [(i % 60, f"s{i % 3}", start + timedelta(days=i % 40)) for i in range(90)]
    schema = "job_id long, skill string, ts timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.run_weekly(spark, source, spark.createDataFrame([], schema).schema, str(tmp_path / "check"), out, "job_id", "skill", "ts")
    first = {}
    for j, s, ts in rows:
        first.setdefault(j, (s, ts))
    want = {}
    for s, ts in first.values():
        y, w, _ = ts.isocalendar()
        want[s, f"{y}-W{w:02d}"] = want.get((s, f"{y}-W{w:02d}"), 0) + 1
    got = {(r.skill, r.week): r.n for r in sinks.table(spark, out).collect()}
    assert sum(got.values()) == 60 and got == want


def test_stream_upsert(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "t")
    for ids in ([1, 2], [2, 3]):
        spark.createDataFrame([(i, "v") for i in ids], "k long, v string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k long, v string").parquet(source)
        incremental.upsert_postings(stream, table, "k", str(tmp_path / "c")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(table).collect()) == [1, 2, 3]


def test_items_are_counted_before_they_meet_the_skills(spark):
    """`weekly_by` equals `weekly` of the join; an item seen under two documents counts once a week; few rows meet the skills."""
    rng = random.Random(6)
    seen = [(i, rng.randrange(5), f"w{rng.randrange(3)}") for i in range(300)]
    seen += [(i, rng.randrange(5), f"w{rng.randrange(3)}") for i in range(40)] + [(i, 1, "w0") for i in range(900, 910)] * 2 + [(None, 1, "w1"), (950, 2, None), (951, None, "w1"), (952, 77, "w1")]
    named = [(d, s) for d in range(5) for s in "abcdefgh"[: d + 3]] + [(60, "z")]
    a, b = spark.createDataFrame(seen, "event_id long, doc_id long, week string"), spark.createDataFrame(named, "doc_id long, skill_id string")
    got = trends.weekly_by(a, b, "event_id", "doc_id", "skill_id", "week")
    rows = lambda df: sorted(map(tuple, df.select("skill", "week", "n").collect()), key=str)
    want = rows(trends.weekly(a.join(b, "doc_id"), "event_id", "skill_id", "week"))
    assert rows(got) == want and len(want) > 20


def test_found_words_are_dealt_before_they_are_hashed(spark):
    """No task keeps a map of all words of its split; repeated rows and items still count once."""
    docs = spark.createDataFrame([(1, "sql go sql"), (1, "go"), (2, "sql"), (None, "go")], "doc_id long, text string")
    known = spark.createDataFrame([(5, "sql"), (6, "go")], "skill_id long, name string")
    found = extraction.extract_words(docs, known)
    assert "REPARTITION_BY_COL" in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 5), (1, 6), (2, 5), (None, 6)]
    members = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a")], "item_id long, cluster_id string")
    top = views.cluster_top_skills(found.withColumnRenamed("doc_id", "item_id").unionByName(found.withColumnRenamed("doc_id", "item_id")), members)
    assert {(r["skill_id"], r["n"], r["total"]) for r in top.collect()} == {(5, 2, 4), (6, 1, 4)}


def test_elements_leave_a_task_in_small_batches(spark, monkeypatch):
    """A task doesn't hold the elements of a whole batch of pages."""
    monkeypatch.setattr(catalogs, "SENT", 3)
    pages = spark.createDataFrame([(i, "<h1>a</h1><ul>" + "<li>x <b>y</b></li>" * i + "</ul>") for i in range(6)] + [(9, None)], "page_id long, html string")
    got = sorted((r["page_id"], r["pos"], r["tag"]) for r in catalogs.outline(pages).collect())
    assert got == sorted((i, j, "h1" if not j else "li" if j % 2 else "b") for i in range(6) for j in range(2 * i + 1))


def test_words_split_as_by_the_list_of_characters(spark):
    """`tx.words` splits by \\W as by the negated list, for letters whose lower case is or isn't ASCII too; the list isn't tried."""
    texts = ["The C++ node_js v2, naïve İstanbul Kelvin ΣΑΣ", "", None, " ,lead and trail. ", "x\u0000y\tz w v", "日本 term 🙂emoji", "ſtrange ＡＢＣ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    old = F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9_]+")
    assert [r.a for r in df.select(tx.words(F.col("text")).alias("a")).collect()] == [r.b for r in df.select(old.alias("b")).collect()]
    assert "[^a-z" not in df.select(tx.words(F.col("text")))._jdf.queryExecution().toString()


def test_events_are_hashed_and_skills_numbered_once(spark, monkeypatch, tmp_path):
    """Items with numbers and dates go without a sort by `weekly_by`; a null week counts as a week; recommendations number the skills once."""
    seen = [(1, 5, None), (1, 5, None), (2, 5, None), (2, 5, date(2024, 1, 1)), (3, 5, date(2024, 1, 1)), (3, 6, date(2024, 1, 1)), (4, None, date(2024, 1, 8)), (4, 6, date(2024, 1, 8))]
    a = spark.createDataFrame(seen, "item long, doc long, week date")
    b = spark.createDataFrame([(5, 1), (6, 1), (6, 2)], "doc long, skill long")
    got = trends.weekly_by(a, b, "item", "doc", "skill", "week")
    rows = lambda df: sorted(map(tuple, df.select("skill", "week", "n").collect()), key=str)
    assert rows(got) == rows(trends.weekly(a.join(b, "doc"), "item", "skill", "week"))
    assert "SortAggregate" not in got._jdf.queryExecution().toString()

    calls, skills = [], domain.skills
    monkeypatch.setattr(domain, "skills", lambda *x: calls.append(1) or skills(*x))
    domain.recommendations(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
