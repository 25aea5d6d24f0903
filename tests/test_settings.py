"""Settings files: what is read, defaulted and refused."""

from __future__ import annotations

import json

import pytest

from skyloom.plans import settings

GOOD = {
    "topics": ["spin"], "scout": {"categories": ["quant-ph"], "lookback_days": 2}, "corpus": {"source": "refs/works.json"}, "ranking": {"weights": {"llm": "0.6", "scites": 1}}, "connect": {"openalex_mailto": "a@b.c"},
    "llm": {"light": {"provider": "p", "model": "m", "api_key_env": "SKYLOOM_TEST_KEY"}, "heavy": {"provider": "p", "model": "m", "api_key_env": "SKYLOOM_NO_KEY", "base_url": None}},
}


def write(tmp_path, value, name="settings.json"):
    (tmp_path / "config").mkdir(exist_ok=True)
    path = tmp_path / "config" / name
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return path


def test_read_with_defaults(tmp_path, monkeypatch):
    monkeypatch.delenv("SKYLOOM_TEST_KEY", raising=False)
    (tmp_path / ".env").write_text("# keys\nexport SKYLOOM_TEST_KEY='abc'\nbroken\n")
    out = settings.load(write(tmp_path, GOOD))
    assert (out.topics, out.scout.lookback_days, out.scout.max_results, out.ranking.weights, out.ranking.top_n) == (["spin"], 2, 200, {"llm": 0.6, "scites": 1.0}, 5)
    assert out.corpus.source == str(tmp_path / "refs/works.json") and out.retention == settings.Retention() and out.connect.arxiv_bib
    assert out.role("light").api_key == "abc" and out.role("heavy").base_url == ""
    for wrong in (lambda: out.role("heavy").api_key, lambda: out.role("other")):
        with pytest.raises(settings.SettingsError):
            wrong()
    monkeypatch.delenv("SKYLOOM_TEST_KEY")


def test_toml_and_yaml(tmp_path):
    toml = 'topics = ["spin"]\n[scout]\ncategories = ["a"]\n[ranking.weights]\nllm = 1\n[connect]\nenabled = false\n[llm.light]\nprovider = "p"\nmodel = "m"\napi_key_env = "K"\n[llm.heavy]\nprovider = "p"\nmodel = "m"\napi_key_env = "K"\n'
    assert settings.load(write(tmp_path, toml, "s.toml")).ranking.weights == {"llm": 1.0}
    pytest.importorskip("yaml")
    assert settings.load(write(tmp_path, json.dumps(GOOD), "s.yaml")).scout.categories == ["quant-ph"]


@pytest.mark.parametrize("change, said", [
    ({"topics": []}, "topics"), ({"scout": None}, "scout is missing"), ({"scout": {}}, "scout is missing"), ({"scout": {"lookback_days": 1}}, "scout.categories is missing"), ({"scout": {"categories": "quant-ph"}}, "scout.categories"),
    ({"scout": {"categories": ["a"], "lookback_days": "two"}}, "scout.lookback_days"), ({"ranking": {"weights": {}}}, "ranking.weights"), ({"ranking": {"weights": {"llm": "x"}}}, "ranking.weights.llm"), ({"retention": {"days": 0}}, "retention.days"),
    ({"retention": {"enabled": "no"}}, "retention.enabled"), ({"connect": {}}, "openalex_mailto"), ({"llm": {"light": GOOD["llm"]["light"]}}, "llm.heavy is missing"), ({"llm": {**GOOD["llm"], "heavy": {"provider": "p"}}}, "llm.heavy.model is missing"),
    ({"llm": ["light"]}, "llm"), ({"typo": 1}, "unknown typo"), ({"retention": {"day": 3}}, "unknown day"),
])
def test_refused(tmp_path, change, said):
    with pytest.raises(settings.SettingsError, match=said):
        settings.load(write(tmp_path, {**GOOD, **change}))


@pytest.mark.parametrize("name, content", [("s.json", "{"), ("s.toml", "a = ["), ("s.json", "[1]")])
def test_broken_files(tmp_path, name, content):
    with pytest.raises(settings.SettingsError):
        settings.load(write(tmp_path, content, name))
    with pytest.raises(settings.SettingsError, match="doesn't exist"):
        settings.load(tmp_path / "none.json")
