"""Every registered query of the library against its SQL twin."""

import pytest

from pagelens import catalog

from oracle import connect, oracle_rows, rows_of


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_twin(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    assert rows_of(df, columns) == oracle_rows(con, catalog.ORACLE[name], columns)


def test_all_have_twins():
    """But two: a classifier and the template roles, which are tested below."""
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"intent_label", "template_slots"}


def test_intent_held_out(spark, sf):
    """Languages of documents that the classifier hasn't seen."""
    got = catalog.QUERIES["intent_label"](spark, sf).where("held_out").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) > 20 and sum(r.predicted == lang[r.doc_id] for r in got) >= 0.9 * len(got)


def test_template_slots(spark, sf):
    """One title, language and first heading a page, and no more paragraphs than there are elements for them; the first three also have a twin."""
    from collections import Counter

    rows = catalog.QUERIES["template_slots"](spark, sf).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    by = Counter()
    for r in rows:
        by[r.template_id, r.role] += r.n
        assert r.role != "title" or r.max_length == 60
    for i, html in pages.items():
        assert by[i, "title"] == by[i, "lang"] == by[i, "h1"] == 1
        assert by[i, "paragraph"] <= html.count("<p")


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
