"""Settings from defaults, a file and the environment."""

import pytest

from foliant.settings import AgentSettings, RetrievalSettings, env_file


def test_order_of_sources(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / ".env").write_text("# tides\nRAG_SEARCH_K=7\nexport RAG_RRF_K = 30\nRAG_HYPHEN_TOKENS='true'\n\nno setting\nRAG_EMBEDDING_MODEL=\"a=b\"\n")
    monkeypatch.setenv("RAG_RRF_K", "20")
    own = RetrievalSettings.from_env("RAG_")
    assert (own.search_k, own.rrf_k, own.hyphen_tokens, own.embedding_model, own.overlap) == (7, 20, True, "a=b", 50)
    assert RetrievalSettings.from_env("RAG_", {}) == RetrievalSettings() and env_file("elsewhere") == {}


@pytest.mark.parametrize(("kind", "name", "value"), [(RetrievalSettings, "search_k", 0), (RetrievalSettings, "rrf_vector_weight", 0.0), (RetrievalSettings, "overlap", -1), (AgentSettings, "wall_clock_s", 0.0)])
def test_bounds(kind, name, value):
    with pytest.raises(ValueError, match=name):
        kind(**{name: value})


def test_zero_switches_off():
    assert RetrievalSettings(overlap=0, min_body_length=0).overlap == 0
