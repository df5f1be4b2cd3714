import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.functions import text as T

ALPHABET = "ab Z9_.-!?\n\té中ไทยก่ "
TEXT = st.text(alphabet=ALPHABET, max_size=40)
some = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


def share(x):
    solid = [c for c in x if not c.isspace()]
    return sum("฀" <= c <= "๿" for c in solid) / len(solid) if solid else 0.0


def words(x):
    x = x.strip()
    if not x:
        return 0
    if share(x) < 0.15:
        return len(x.split())
    thai = "".join(c for c in x if "฀" <= c <= "๿")
    letters = sum(unicodedata.category(c) != "Mn" for c in unicodedata.normalize("NFD", thai))
    return max(round(letters / 3.5) + len(re.sub("[฀-๿]+", " ", x).split()), 1)


@some
@given(st.lists(TEXT, min_size=20, max_size=40))
def test_words(spark, values):
    assert column(spark, values, T.count_words) == [words(v) for v in values]


@some
@given(st.lists(TEXT, min_size=20, max_size=40), st.text(alphabet="ab9_.ท", min_size=1, max_size=3))
def test_keyword(spark, values, key):
    def plain(x):
        if share(key) >= 0.15:
            return x.lower().count(key)
        return len(re.findall(rf"(?<![0-9A-Za-z_]){re.escape(key)}(?![0-9A-Za-z_])", x.lower()))

    assert column(spark, values, lambda c: T.count_keyword(c, F.lit(key))) == [plain(v) for v in values]
    assert column(spark, values, lambda c: T.count_substring(c, F.lit(key))) == [v.lower().count(key) for v in values]


@some
@given(st.lists(TEXT, min_size=20, max_size=40))
def test_tokens(spark, values):
    def tokens(x):
        x = x.lower()
        got = set(re.findall(r"[^\W\d_]{4,}", x))
        if x and share(x) >= 0.15:
            thai = "".join(c for c in x if "฀" <= c <= "๿")
            got |= {thai[i : i + 4] for i in range(len(thai) - 3)}
        return sorted(got)

    assert [list(x) for x in column(spark, values, T.token_set)] == [tokens(v) for v in values]


def test_slugs(spark):
    values = ["Hello, World!", "ไทย ก่อน", "con", "", None, "a.b/c?d", "x" * 100]
    assert column(spark, values, T.file_slug)[0] == "hello-world"
    assert column(spark, values, T.file_slug)[2] == "con-halaman"
    assert len(column(spark, values, T.file_slug)[6]) == 80
    assert column(spark, values, T.url_slug) == ["hello-world", "ไทย-ก่อน", "con", "halaman", "halaman", "a-b-c-d", "x" * 100]
    assert column(spark, values, T.anchor_id)[1:5] == ["ไทย-ก่อน", "con", "bagian", "bagian"]


def test_small_functions(spark):
    assert column(spark, ["<a href='x'>&\"", None], T.html_escape) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;", ""]
    assert column(spark, ["short", "123456789012"], T.mask) == ["*****", "1234****9012"]
    assert column(spark, ["a { b : c ; } /* x */ d{}"], T.minify_css) == ["a{b:c}d{}"]
    assert column(spark, ["One. Two!  Three", ""], lambda c: F.size(T.sentences(c))) == [3, 0]
    assert column(spark, ["word " * 30], lambda c: F.length(T.truncate_words(c, 22))) == [19]
    assert column(spark, ["Rest"], lambda c: T.ensure_contains(c, F.lit("Key"), 40)) == ["Key - Rest"]
    assert column(spark, ["abcdefg"], T.estimate_tokens) == [2]
    assert column(spark, ["id_ID"], T.language_tag) == ["id-ID"]
    assert column(spark, ["<b>&"], T.json_for_html) == ["\\u003cb\\u003e\\u0026"]
    assert column(spark, ["5"], lambda c: T.round_up(c.cast("int"), 4)) == [8]
    assert column(spark, ["ไทยไทย abc"], lambda c: T.count_words_by_mode(c, F.lit(True))) == [3]
    assert column(spark, ["1.5", "x"], T.number) == [1.5, 0.0]
    assert column(spark, [" a ,,b"], lambda c: T.bullets(F.split(c, ","), 5)) == ["- a\n- b"]
    assert column(spark, ["My Font"], lambda c: T.font_stack(F.array(c), F.array(F.lit("Arial"), F.lit("My Font")))) == ['"My Font", Arial']


def test_headings_of_all_lines(spark, tmp_path):
    """Lines after the twelfth get anchors, and headings repeated after the eighth are duplicates."""
    from pagelens import catalog

    lines = ["the one", *[f"line {i}" for i in range(2, 15)], "Late", "late", "line 2", "Late"]
    spark.createDataFrame([(1, "\n".join(lines)), (2, "one")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).where("doc_id = 1")
    anchors = {r.pos: r.anchor for r in run("unique_anchor_ids_all").collect()}
    assert len(anchors) == 18 and [anchors[i] for i in (14, 15, 16, 17, 18)] == ["line-14", "late", "late-2", "line-2-2", "late-3"]
    assert [r.duplicates for r in run("duplicate_headings_all").collect()] == ["late|line 2"]
    assert [r.score for r in run("heading_score_all").collect()] == [100 - 5 - 2 * 2]


def test_file_slug_of_reserved_names(spark, tmp_path):
    """The query gives slugs alone, as its SQL does; the function guards them unless told otherwise."""
    from pagelens import catalog

    spark.createDataFrame([(1, "Con\nx"), (2, "aux"), (3, "A b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.slug for r in catalog.QUERIES["file_slug"](spark, str(tmp_path)).collect()} == {1: "con", 2: "aux", 3: "a-b"}


def test_cut_of_long_texts(spark):
    """A cut is told by a text's beginning, whatever space lies in it; the rest isn't looked at."""
    texts = ["　 a \n" * 100, "x" * 60 + "   ", " " * 500 + "y" * 61, "word, " * 9 + "z" * 70, "", None]
    whole = [" ".join((t or "").split()) for t in texts]
    want = [w if len(w) <= 60 else (w[:60].rsplit(" ", 1)[0] if " " in w[:60] and w[:60].rindex(" ") > 36 else w[:60]).rstrip(" ,.;:-") for w in whole]
    assert column(spark, texts, lambda c: T.truncate_words(c, 60)) == want
    plan = spark.range(1).select(T.ensure_contains(F.repeat(F.col("id").cast("string"), 9), F.lit("Key"), 40).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("{0,41}") == 1
