import re

import pytest
from corpus import DOCS

from corpusloom.api import Corpus
from corpusloom.functions.text import ID_GRAMMAR, canonical_json, new_id
from corpusloom.operators import graph
from corpusloom.sources import exports, index
from corpusloom.streaming import incremental


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in DOCS.items()], "path string, content binary"), provider="jira")


def test_answers(corpus, spark):
    assert corpus.totals().first().invalid == 3 and corpus.portfolio().first().checked == 4
    assert corpus.resolve("dec-2") == ("resolved", ["dec/DEC-2-new.md"])
    assert [r.path for r in corpus.find("store").collect()] == ["dec/DEC-2-new.md", "dec/DEC-1-old.md"]
    assert [r.path for r in corpus.retrieve("old store").collect()] == ["dec/DEC-2-new.md"]
    assert [r.id for r in corpus.decisions_for("src/store").collect()] == ["DEC-2"]
    assert {r.path: r.hops for r in corpus.related("plan.md", 2).collect()} == {"plan.md": 0, "req/req-1.md": 1, "dec/DEC-2-new.md": 2}
    assert corpus.index().first().path == "dec/DEC-1-old.md" and corpus.improve().count() > 0 and corpus.inspect().count() == 5
    assert {r.code for r in corpus.gate({"off": ["target-not-found"]}).collect()} & {"target-not-found"} == set()
    corpus.register()
    assert spark.sql("select count(*) from edges where issue = 'target-not-found'").first()[0] == 1
    assert spark.sql("select casefold('Straße')").first()[0] == "strasse"


def test_proposed_document(corpus):
    found = corpus.validate_proposed(b"# X\n\n## Context\n\na\n\n## Decision\n\nb\n\n## Consequences\n\nc\n\n## Supersedes\n\n- nowhere\n", "new.md")
    assert {r.code for r in found.collect()} == {"target-not-found"}


def test_compare_states(corpus, spark):
    changed = dict(DOCS)
    changed["req/req-1.md"] = changed["req/req-1.md"].replace("must lock an account after 5 tries", "might be fast")
    newer = Corpus(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in changed.items()], "path string, content binary"))
    out = corpus.compare(newer)
    assert [(r.path, r.change) for r in out["changes"].collect()] == [("req/req-1.md", "modified")]
    assert corpus.compare(corpus)["changes"].collect() == []
    assert out["types"].where("delta <> 0").collect() == [] and out["recommendations"].count() >= 0


def test_small_parts(corpus, spark, tmp_path):
    assert re.match(ID_GRAMMAR, new_id("APP", 1_700_000_000_000, 12345)) and canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    texts = spark.createDataFrame([("t", "see DEC-1 and (dec-2), not DEC-9")], "path string, text string")
    got = exports.citations(texts, graph.alias_table(corpus.documents)).collect()
    assert {(r.token, r.target) for r in got} == {("DEC-1", "dec/DEC-1-old.md"), ("dec-2", "dec/DEC-2-new.md")}
    base = spark.range(20_000).selectExpr("cast(id as string) as path", "id as v")
    up, dead = base.where("v < 9000"), base.where("v >= 18000").select("path")
    assert incremental.compact(str(tmp_path / "i"), base, up.limit(5), dead.limit(5)) is None
    assert incremental.compact(str(tmp_path / "i"), base, up, dead) and index.current(spark, str(tmp_path / "i"))["base"].count() == 18_000
