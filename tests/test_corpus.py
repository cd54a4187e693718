"""The build from a folder of pages, and the command line over it."""

import json

import pytest

from foliant.__main__ import main
from foliant.errors import EngineError
from foliant.plans import corpus, url_rules
from foliant.settings import RetrievalSettings
from foliant.sources import tables


def page(title, body):
    return f'<html><body><div id="article-content"><div class="breadcrumbs"><a href="/">Home</a></div><h1>{title}</h1>{body}</div></body></html>'


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "html").mkdir()
    for slug, title, words in (("spells__fireball", "Fireball", "fire damage in a burst"), ("spells__frost", "Frost", "cold damage in a cone"), ("feats__dodge", "Dodge", "armour against attacks")):
        (root / f"html/{slug}.html").write_text(page(title, f"<h2>Effect</h2><p>{words}. {'more text follows here. ' * 10}</p>"))
    (root / "html/feats__stub.html").write_text(page("Stub", "<p>x</p>"))
    settings = RetrievalSettings(embedding_dim=64)
    manifest = corpus.build(tables.html_folder(spark, str(root / "html")), str(root / "out"), "https://rules.example.com", settings).first()
    return root, settings, manifest


def test_discover_urls(tmp_path, capsys):
    site = url_rules._SITE
    pages = ["/traits/faith-traits/birthmark/", "/traits/campaign-traits/other/", "/feats/dodge/", "/feats/3pp/parry/", "/skills/swim/", "/about/"]
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps" / "map-page-3.xml").write_text("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(f"<url><loc>{site}{p}</loc></url>" for p in pages) + "</urlset>")
    assert main(["discover-urls", str(tmp_path / "maps"), str(tmp_path / "links")]) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["6 urls in sitemaps, 3 kept", "feats 1"]


def test_build(spark, built):
    root, settings, manifest = built
    assert manifest.n_articles == 3 and manifest.n_chunks == 3
    assert {r.doc_id for r in corpus.load_articles(spark, f"{root}/out").collect()} == {"spells__fireball", "spells__frost", "feats__dodge"}
    with pytest.raises(EngineError):
        corpus.build(tables.html_folder(spark, str(root / "html")).filter("slug = 'feats__stub'"), str(root / "none"), "https://x.com", settings)


def test_search_ask_evaluate(spark, built):
    root, settings, _ = built
    r = corpus.load(spark, f"{root}/out", settings, advertised=["spells"])
    queries = spark.createDataFrame([(1, "fireball", "exact_name", ["https://rules.example.com/spells/fireball"]), (2, "cold damage", "paraphrase", ["https://rules.example.com/spells/frost"])], "query_id bigint, query string, type string, expected_urls array<string>")
    assert r.search(queries.filter("query_id = 1"), k=1, method="bm25").first().title == "Fireball"
    results, summary, _ = corpus.evaluate(r, queries, 3, "bm25")
    assert [x.rank for x in results.collect()] == [1, 1] and summary.filter("grouping = 'overall'").first().mrr == 1.0
    rates = corpus.evaluate_answers(r, queries, method="bm25", k=2)[1].filter("grouping = 'overall'").first()
    assert rates.retrieval_rate == rates.citation_rate == 1.0 and rates.invented_citation_rate == 0


def test_command_line(spark, built, capsys, monkeypatch):
    root, *_ = built
    monkeypatch.setenv("RAG_EMBEDDING_DIM", "64")
    (root / "q.jsonl").write_text(json.dumps({"query": "dodge", "type": "exact_name", "expected_urls": ["https://rules.example.com/feats/dodge"]}) + "\n")
    assert main(["search", f"{root}/out", "fireball", "--method", "bm25", "--no-rerank"]) == 0
    assert "Fireball" in capsys.readouterr().out
    assert main(["evaluate", f"{root}/out", str(root / "q.jsonl"), "--k", "3", "--method", "bm25", "--no-rerank", "--run-dir", f"{root}/runs"]) == 0
    assert "R@1 1.00" in capsys.readouterr().out
    assert main(["search", f"{root}/out", "x", "--k", "0"]) == 1
