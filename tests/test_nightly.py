"""A night by command line over a search fixture, with scripted models."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from skyloom import __main__ as cli
from skyloom.plans import nightly, providers, settings
from skyloom.sources import search

DAY = dt.date(2026, 8, 14)
say = lambda **x: json.dumps(x)
MODELS = {
    "light": providers.Scripted({"Summary: ": say(relevant=True, score=0.9, matched=["spin"], reason="fits")}, say(summary="s", research_question="q", contribution="c")),
    "heavy": providers.Scripted({}, say(claim="claim", stakes="st", connection="co", verdict="READ")),
}


@pytest.fixture(scope="module")
def config(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("night")
    rows = [("a", 0, 0, "x/abs/2401.00001v1", "First", "text one", DAY, "Ann One"), ("a", 0, 1, "x/abs/2401.00002", "Second", "text two", DAY, "Bo Two"), ("a", 1, 100, "x/abs/2301.00003", "Old", "text", DAY - dt.timedelta(40), "C"),
            ("b", 0, 0, "x/abs/2401.00001v2", "First again", "text one", DAY, "Ann One"), ("c", 0, 0, "x/abs/2401.00009", "Unasked", "text", DAY, "D")]
    search.write_pages(spark.createDataFrame(rows, "category string, page int, pos long, id string, title string, summary string, published date, author string"), str(base / "pages"))
    role = {"provider": "p", "model": "m", "api_key_env": "K"}
    own = {"topics": ["spin"], "scout": {"categories": ["a", "b"], "pages": str(base / "pages")}, "ranking": {"weights": {"llm": 1}, "top_n": 1}, "connect": {"enabled": False}, "llm": {"light": role, "heavy": role}}
    (base / "config").mkdir()
    (base / "config/s.json").write_text(json.dumps(own))
    return str(base / "config/s.json")


def call(spark, config, tables, *more):
    return cli.main(["run", "--config", config, "--tables", str(tables), "--date", DAY.isoformat(), *more], spark)


def test_dry_run_writes_nothing(spark, config, tmp_path, capsys):
    assert call(spark, config, tmp_path / "t", "--dry-run") == 0
    out = capsys.readouterr().out
    assert "2 papers" in out and "First" in out and "Old" not in out and "Unasked" not in out and not (tmp_path / "t").exists()


def test_stage_by_stage_equals_a_full_run(spark, config, tmp_path, capsys):
    models = f"{__name__}:MODELS"
    for stage in nightly.STAGES:
        assert call(spark, config, tmp_path / "steps", "--stage", stage, "--models", models) == 0
    assert call(spark, config, tmp_path / "full", "--models", models) == 0
    tables = [sorted(map(tuple, nightly.Tables(spark, str(tmp_path / t)).read("papers", nightly.PAPERS).drop("authors", "topics", "cited_in_corpus").collect())) for t in ("steps", "full")]
    assert tables[0] == tables[1] and len(tables[0]) == 2
    assert "'briefed': 1" in capsys.readouterr().out
    page = nightly.Tables(spark, str(tmp_path / "full")).read(f"briefs/day={DAY}", "document string").first().document
    assert page.startswith(f"# Papers of {DAY}") and "- claim: claim" in page
    assert call(spark, config, tmp_path / "full", "--stage", "scout") == 0  # a paper that is there keeps its progress
    assert "'briefed': 1" in capsys.readouterr().out
    runs = nightly.Tables(spark, str(tmp_path / "full")).read("runs", nightly.RUNS).orderBy("run_id").collect()
    assert [(r.run_id, r.n_scraped, r.n_relevant, r.n_briefed) for r in runs] == [(1, 2, 2, 1), (2, 0, None, None)]


def test_old_papers_go_in_full_runs_only(spark, config, tmp_path):
    own = settings.load(config)
    later = DAY + dt.timedelta(30)
    nightly.run(spark, own, str(tmp_path), DAY, MODELS, "scout")
    nightly.run(spark, own, str(tmp_path), later, MODELS, "rank")
    assert nightly.Tables(spark, str(tmp_path)).read("papers", nightly.PAPERS).count() == 2
    assert nightly.run(spark, own, str(tmp_path), later, MODELS) == {}


@pytest.mark.parametrize("more", [["--stage", "nonsense"], ["--stage", "rank", "--dry-run"], ["--date", "14.08.2026"], []])
def test_refused(spark, config, tmp_path, capsys, more):
    assert call(spark, config, tmp_path, *more) == 2
    assert capsys.readouterr().err.strip()
