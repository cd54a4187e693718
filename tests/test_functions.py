"""URLs, texts, answers, traces, sources and streams on small rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.errors import EngineError
from foliant.functions import passages, text, urls
from foliant.operators import answers, metrics, traces
from foliant.plans.url_rules import SITE_RULES, THIRD_PARTY, check_slugs, filter_urls
from foliant.schemas import EVENT
from foliant.sources import runs, tables
from foliant.streaming import events


def of(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "x string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def X():
    return F.col("x")


def test_urls(spark):
    site = "https://www.site.com"
    assert of(spark, f"{site}/a/b__c/d/?q=1#f", urls.slug(X()), F.size(urls.segments(X())), urls.level(X(), 2), urls.level(X(), 8)) == ("a__b__c__d", 3, "b__c", "")
    assert of(spark, f"{site}/", urls.file_name(X()), F.size(urls.segments(X())), urls.category(X())) == ("index.html", 0, None)
    assert of(spark, f"{site}/x/", urls.file_name(X())) == of(spark, f"{site}/x", urls.file_name(X())) == ("x.html",)
    long, hashed = of(spark, f"{site}/" + "a" * 200, urls.slug(X()), urls.is_hashed(urls.slug(X())))
    assert len(long) == 152 and hashed and of(spark, long, urls.from_slug(X(), site)) == (None,)
    assert of(spark, "b__x__y.html", urls.from_slug(X(), site)) == (f"{site}/b/x/y",)
    assert of(spark, "index", urls.from_slug(X(), site)) == (f"{site}/",)
    assert of(spark, "a_b__c", urls.from_slug(X(), site)) == (f"{site}/a_b/c",)
    assert of(spark, "  HTTPS://Www.Site.COM:80/Path/?q#f ", urls.normalised(X())) == ("https://www.site.com:80/Path",)
    assert of(spark, "https://Site.com/p/#frag", urls.page_form(X())) == ("https://Site.com/p",)
    assert of(spark, "see https://a.com/x/). and (https://b.com), https://a.com/x", urls.found_urls(X())) == (["https://a.com/x", "https://b.com"],)
    with pytest.raises(Exception, match="no category"):
        of(spark, f"{site}/", urls.category(X(), strict=True))


def test_site_rules(spark):
    s = "https://www.d20pfsrd.com"
    kept = [f"{s}/feats/x/", f"{s}/bestiary/monster-listings/aberrations/aboleth/", f"{s}/classes/core-classes/bard/", f"{s}/classes/", f"{s}/alignment-description/rules/", f"{s}/gamemastering/combat/kobold-x"]
    gone = [f"{s}/", f"{s}/extras/x", f"{s}/bestiary/", f"{s}/bestiary/tools/x", f"{s}/bestiary/npc-s/npcs-cr-21/", f"{s}/bestiary/x/kobold-press/", f"{s}/classes/3rd-party-classes/x/", f"{s}/classes/base-classes/a/b/kobold-press", f"{s}/alignment-description/", f"{s}/magic/all-spells/q/", f"{s}/feats/x-3pp/", f"{s}/traits/tools/", f"{s}/gamemastering/a/kobold-press/", None]
    links = spark.createDataFrame([(u,) for u in kept + gone], "url string")
    assert sorted(r.url for r in filter_urls(links, SITE_RULES, THIRD_PARTY).collect()) == sorted(kept)
    with pytest.raises(EngineError):
        check_slugs(spark.createDataFrame([("https://a/b__c",)], "url string"))


def test_text(spark):
    assert of(spark, "Café ÉCOLE straße x_y ½", text.terms(X())) == (["cafe", "ecole", "straße", "x", "y", "½"],)
    assert of(spark, "First one. Second one! 3.14 is pi?  ", text.sentences(X())) == (["First one.", "Second one!", "3.14 is pi?"],)
    assert of(spark, None, text.sentences(X()), text.n_tokens(X()), text.normal_space(X())) == ([], 0, "")
    assert of(spark, "a   b\n\n c<d", text.normal_space(X())) == ("a b c\\<d",)
    assert of(spark, "a b c d e", text.fixed_windows(X(), 2)) == (["a b", "c d", "e"],)
    assert of(spark, "", text.fixed_windows(X(), 2)) == ([],)
    assert of(spark, "<t>x</t>", text.unwrap(X(), "<t>", "</t>")) == ("x",)
    got = of(spark, "a </TOOL_RESULT > b", text.neutralised(X()))[0]
    assert got.startswith("<tool_result>\n") and got.count("</tool_result>") == 1


def test_passages(spark):
    assert of(spark, "x [3] y [1] [3] [99] [a]", passages.cited_numbers(X()), passages.invented(passages.cited_numbers(X()), F.lit(3))) == ([1, 3, 99], [99])
    assert of(spark, "  The retrieved excerpts don't cover this. \n", passages.refused(X())) == (True,)
    for body, failed, category in (("[fatal] x", True, "fatal"), ("Error executing tool y", True, "rephrase"), ('{"error_category": "retryable"}', True, "retryable"), ('{"error_category": null, "a": 1}', False, None), ("fine", False, None), ("<tool_result>\n[rephrase] q\n</tool_result>", True, "rephrase")):
        assert of(spark, body, passages.is_failure(X()), passages.error_category(X())) == (failed, category)


    assert [of(spark, a, passages.bad_arguments(X()))[0] for a in ('{"a": 1}', '{"a": ', "[1]", None)] == [False, True, True, True]


@pytest.mark.parametrize(("at", "want"), [(2000, (1510, 2510)), (10, (0, 1000)), (3970, (3000, 4000)), (None, (0, 1000))])
def test_windows(spark, at, want):
    mark = "M" * 20
    body = "x" * 4000 if at is None else "x" * at + mark + "x" * (4000 - at - 20)
    w = spark.createDataFrame([(body, f"H\n{mark}\nab")], "b string, c string").select(passages.window(F.col("b"), F.col("c"), 1000).alias("w")).first().w
    assert (w.window_start, w.window_end) == want and w.body == body[want[0] : want[1]]


def test_short_body_comes_whole(spark):
    w = spark.createDataFrame([("short", "H\nnone")], "b string, c string").select(passages.window(F.col("b"), F.col("c"), 1000).alias("w")).first().w
    assert (w.body, w.window_start, w.window_end) == ("short", 0, 5)


def test_answers(spark):
    queries = spark.createDataFrame([(1, "what?"), (2, "nothing")], "query_id bigint, query string")
    hits = spark.createDataFrame([(1, 2, "B", ["B", "s"], "u/b", "H\ntwo", "b#0"), (1, 1, "A", ["A"], "u/a", "first\nline", "a#0")], "query_id bigint, rank int, title string, heading_path array<string>, url string, text string, chunk_id string")
    prompt = answers.prompts(queries, hits, "{excerpts}|{question}").orderBy("query_id").collect()
    assert prompt[0].prompt == "[1] A — A\nfirst\nline\n\n[2] B — B > s\nH\ntwo|what?" and prompt[1].prompt is None

    class Fake:
        def generate(self, prompts):
            assert len(prompts) <= 1
            return ["Yes [2], no [7] [2]."] * len(prompts)

    got = {r.query_id: r for r in answers.answer_questions(queries, hits, Fake()).collect()}
    assert [(c.n, c.title, c.url) for c in got[1].citations] == [(2, "B", "u/b")] and got[1].invented == [7]
    assert got[2].text == passages.NO_COVERAGE and got[2].citations == []
    assert answers.answer_questions(queries, hits).filter("query_id = 1").first().text == "first [1]"
    rows = [(1, "t", ["https://e.com/x/1"], "said [1]", ["https://e.com/x/1/"], ["https://e.com/x/1"], []), (2, "t", ["https://e.com/x/2"], passages.NO_COVERAGE, [], [], []), (3, "u", ["https://e.com/y/2"], "[9]", ["https://e.com/q"], ["https://e.com/q"], [9])]
    results = metrics.answer_results(spark.createDataFrame(rows, "query_id bigint, type string, expected_urls array<string>, text string, retrieved_urls array<string>, cited_urls array<string>, invented array<int>"))
    assert [(r.expected_url_retrieved, r.refused, r.cited_correct_source, r.invented_citation) for r in results.orderBy("query_id").collect()] == [(True, False, True, False), (False, True, False, False), (False, False, False, True)]
    overall = metrics.evaluate_answers(results).filter("grouping = 'overall'").first()
    assert overall.refusal_rate == pytest.approx(1 / 3) and overall.n_queries == 3


def test_requests(spark):
    rows = [("ok", 5, None), ("x", 5, None), ("ok", 11, None), ("ok", 5, "none"), (None, 5, None), ("q" * 301, 5, None), ("ok", None, "feats")]
    got = spark.createDataFrame(rows, "q string, k int, c string").select(answers.request_error(F.col("q"), F.col("k"), F.col("c"), ["feats"]).alias("e")).collect()
    assert [r.e for r in got] == [None] + ["rephrase"] * 5 + [None]
    with pytest.raises(EngineError):
        answers.require_positive(title_weight=0)


def test_article_window(spark):
    chunks = spark.createDataFrame([("a#0", "a", "H\nneedle in hay")], "chunk_id string, doc_id string, text string")
    body = "x" * 3000 + "needle in hay" + "y" * 3000
    articles = spark.createDataFrame([("a", "u", "T", "c", ["p"], body, len(body))], "doc_id string, url string, title string, category string, breadcrumb array<string>, body_md string, n_chars int")
    asked = spark.createDataFrame([("a#0", 1000), ("none", 1000), ("a#0", 10)], "chunk_id string, max_chars int")
    got = [(r.error_category, "needle in hay" in (r.body or "")) for r in answers.article_window(asked, chunks, articles).collect()]
    assert sorted(got, key=str) == sorted([(None, True), ("rephrase", False), ("rephrase", False)], key=str)


TRANSCRIPT = "run string, seq int, role string, content string, tool_calls array<struct<id:string,name:string>>, tool_call_id string"


def test_traces(spark):
    rows = [
        ("r", 1, "assistant", "", [("1", "rag_search"), ("2", "fetch_section")], None), ("r", 2, "tool", "<tool_result>\nhttps://a.com/x body\n</tool_result>", None, "1"),
        ("r", 3, "tool", "[fatal] no", None, "2"), ("r", 4, "tool", "Error executing tool", None, "9"), ("r", 5, "assistant", "see https://a.com/x/ and https://b.com/y#z.", None, None),
    ]
    t = spark.createDataFrame(rows, TRANSCRIPT)
    assert {(r.tool, r.called, r.failed) for r in traces.tool_tally(t).collect()} == {("rag_search", 1, 0), ("fetch_section", 1, 1), ("unknown", 0, 1)}
    assert traces.tool_tokens(t).first().tool_tokens == 5 + 2 + 5
    answer = spark.createDataFrame([("r", rows[-1][3]), ("s", None)], "run string, text string")
    got = {r.run: (r.citations, r.ungrounded) for r in traces.grounding(answer, t).collect()}
    assert got == {"r": (2, ["https://b.com/y#z"]), "s": (0, [])}
    hit = lambda e: answer.filter("run = 'r'").select(traces.expected_hit(F.col("text"), e).alias("h")).first().h
    assert hit(F.array(F.lit("https://b.com/y"))) is True and hit(F.array(F.lit("https://c.com"))) is False and hit(F.array().cast("array<string>")) is None
    assert traces.final_messages(t).first().seq == 5
    assert traces.repeats(answer, 3).count() == 6


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (4, 1, 3, 2)] + [("b", 7.0), ("b", None)], "k string, v double")
    got = {r.k: (r.p50, r.p95) for r in traces.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (3.0, 4.0), "b": (7.0, 7.0)}


def test_history(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}" if i != 3 else " ") for i in range(26)] + [(2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "user", "q2"), (2, 3, "assistant", "a" * 5000)]
    pairs = traces.turn_pairs(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    h = traces.history(pairs).orderBy("conv_id", "turn_no").collect()
    assert len([r for r in h if r.conv_id == 1]) == 10 and h[-1].question == "q2" and len(h[-1].answer) == 4000
    asked = spark.createDataFrame([(2, "next"), (3, "new")], "conv_id bigint, question string")
    got = {r.conv_id: [(m.role) for m in r.messages] for r in traces.replay(traces.history(pairs), asked, "sys").collect()}
    assert got == {2: ["system", "user", "assistant", "user"], 3: ["system", "user"]}


def test_reports(spark):
    rows = [("q1", "t", 1, True, False, [], 2, 3.0, 1, 0, 0, 0), ("q1", None, 0, None, True, ["u"], 1, 5.0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "question string, type string, n_calls int, expected_hit boolean, no_coverage boolean, ungrounded array<string>, hops int, seconds double, searches int, searches_failed int, fetches int, fetches_failed int")
    overall = traces.report(df, traces.quality_columns()).filter("grouping = 'overall'").first()
    assert (overall.searched, overall.cited, overall.refused, overall.fabricated) == (0.5, 1.0, 0.5, 0.5)
    assert {(r.grouping, r.key) for r in traces.report(df, traces.loop_columns()).collect()} == {("overall", None), ("type", "t"), ("type", "untyped"), ("question", "q1")}
    reason = lambda *v: spark.range(1).select(traces.stop_reason(*map(F.lit, v)).alias("r")).first().r
    assert [reason(1, 0, 1, 1, 1), reason(0, 1, 1, 1, 1), reason(0, 0, 121, 1, 1), reason(0, 0, 1, 4001, 9), reason(0, 0, 1, 1, 8), reason(0, 0, 1, 1, 1)] == ["fatal_tool_error", "llm_unavailable", "wall_clock", "context_budget", "max_iters", "answer"]


def test_json_lines(spark, tmp_path):
    good, bad, empty = tmp_path / "g.jsonl", tmp_path / "b.jsonl", tmp_path / "e.jsonl"
    good.write_text('{"query": "a", "type": "t", "expected_urls": ["u"]}\n\n{"question": "b"}\n')
    bad.write_text('{"query": "a"}\n\n{"query": \n')
    empty.write_text("\n \n")
    assert [(r.query_id, r.query, r.expected_urls) for r in tables.eval_queries(spark, str(good)).orderBy("query_id").collect()] == [(1, "a", ["u"]), (3, "b", [])]
    with pytest.raises(EngineError, match=":3:"):
        tables.eval_queries(spark, str(bad))
    with pytest.raises(EngineError, match="no rows"):
        tables.eval_queries(spark, str(empty))


def test_sources(spark, tmp_path):
    (tmp_path / "html").mkdir()
    (tmp_path / "html/a__b.html").write_text("<p>é</p>", encoding="utf-8")
    (tmp_path / "html/x.txt").write_text("no")
    assert [tuple(r) for r in tables.html_folder(spark, str(tmp_path / "html")).collect()] == [("a__b", "<p>é</p>")]
    (tmp_path / "r.txt").write_text("# c\n\na: one: two\nb: x\n")
    assert tables.resource(spark, str(tmp_path / "r.txt"), ["a"]) == {"a": "one: two", "b": "x"}
    with pytest.raises(EngineError, match="r.txt"):
        tables.resource(spark, str(tmp_path / "r.txt"), ["zz"])
    xml = '<urlset xmlns="http://x/y"><url><loc>https://s.com/a/b/</loc></url><url><loc>https://s.com/</loc></url></urlset>'
    got = tables.sitemap(spark.createDataFrame([("https://s.com/page-3.xml", xml)], "url string, xml string")).collect()
    assert [(r.sitemap_page, r.url, r.level_1, r.level_2, r.level_8) for r in got] == [(3, "https://s.com/a/b/", "a", "b", ""), (3, "https://s.com/", "", "", "")]
    with pytest.raises(Exception, match="no page number"):
        tables.sitemap(spark.createDataFrame([("https://s.com/x.xml", xml)], "url string, xml string")).collect()
    links = spark.createDataFrame([("https://s.com/a/b",), ("https://s.com/c",)], "url string")
    assert [r.slug for r in tables.not_crawled(links, tables.html_folder(spark, str(tmp_path / "html"))).collect()] == ["c"]
    tables.write_pages(spark.createDataFrame([("https://s.com/c", b"<p>c</p>")], "url string, body binary"), str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages")).first().slug == "c"
    path = runs.write_run(spark.range(1), spark.range(2), str(tmp_path), k=5)
    assert spark.read.json(f"{path}/results").count() == 2 and spark.read.json(f"{path}/provenance").first().k == "5"


def event(seq, kind, run="r1", **more):
    return tuple({"run": run, "seq": seq, "type": kind, **more}.get(n) for n in EVENT.names)


RUN = [event(1, "run_started", question="q"), event(2, "tool_started", call_id="a", name="s"), event(3, "tool_started", call_id="b"), event(4, "tool_finished", call_id="a"), event(1, "run_started", "r2"), event(2, "tool_started", "r2", call_id="c"), event(3, "run_failed", "r2", stopped_reason="wall_clock", text="secret")]
WANT = {("r1", 4, 2, 1, 1, False, None), ("r2", 3, 1, 0, 0, True, "wall_clock")}


def test_batch_fold_and_log(spark, tmp_path):
    df = spark.createDataFrame(RUN, EVENT)
    runs.append_events(df, f"{tmp_path}/log")
    assert {tuple(r) for r in events.fold_batch(runs.read_events(spark, f"{tmp_path}/log")).collect()} == WANT
    assert [r.text for r in events.failures_hidden(df).filter("type = 'run_failed'").collect()] == ["the run failed"]
    assert spark.range(1).select(events.run_id(F.col("id")).alias("r")).filter("r RLIKE '^[0-9a-f]{8}$'").count() == 1


def test_stream_fold_over_batches(spark, tmp_path):
    """State goes on from batch to batch; the last row of a run is its state."""
    for part in (RUN[:2], RUN[2:5], RUN[5:]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    folded = events.fold(events.read_stream(spark, f"{tmp_path}/in", 1))
    states = events.run_to_table(folded, f"{tmp_path}/out", f"{tmp_path}/ck", "update")
    last = {}
    for r in states.orderBy("n_events").collect():
        last[r.run] = tuple(r)[:7]
    assert set(last.values()) == WANT
    query = events.write_log(events.read_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/copy", f"{tmp_path}/ck2")
    query.awaitTermination()
    assert spark.read.schema(EVENT).json(f"{tmp_path}/copy").count() == len(RUN)


def test_windows_of_time(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:50:00"), (1, "2024-01-01 03:00:00"), (2, "2024-01-01 00:59:59")], "u int, s string").select("u", F.to_timestamp("s").alias("ts"))
    assert sorted((r.u, r.n) for r in events.sessions(df, "ts", "u", "1 hour").collect()) == [(1, 1), (1, 2), (2, 1)]
    assert sorted(r.n for r in events.tumbling(df, "ts", "1 hour", []).collect()) == [1, 3]


def test_schema_without_session():
    assert isinstance(EVENT, T.StructType)
