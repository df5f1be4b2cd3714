"""The pipeline's stages, each on its own input, against brute force in plain Python."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from pagelens.llm import mixing, quality_rules
from pagelens.llm.common import read

pipeline = pytest.importorskip("corpus_pipeline")
sys.path.insert(0, str(Path(__file__).parent))

from test_operators import WORD, brute_kept, brute_mix, classes, features, sha, shingles  # noqa: E402


def ratios(t):
    """The ratios that rules test, by name."""
    t = t or ""
    w = WORD.findall(t)
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _ = features(t)
    count = lambda chars: sum(t.count(c) for c in chars)
    div = lambda a, b: a / b if b else 0.0
    return {
        "symbols_per_word": div(n_symbols, n_words), "chars_per_word": div(word_chars, n_words), "repeat_share": div(n_repeat_words, n_words), "dup_lines_per_word": div(n_dup_lines, n_words),
        "upper_share": div(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), word_chars), "digit_share": div(count("0123456789"), word_chars),
        "mark_share": div(count("!?.,;:\"'()[]{}-_=+/\\@^~`"), word_chars), "distinct_share": div(len(set(w)), n_words), "n_words": float(n_words),
    }


def rejected(t, rules):
    r = ratios(t)
    return any(all((r[c.feature] >= c.threshold) == c.above for c in rule) for rule in rules)


def brute_near(rows):
    """The ids that stay, from all pairs of sets that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    pairs = {(a, b) for ds in holders.values() for a in ds for b in ds if a < b}
    linked = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {d for d, c in classes(list(sets), linked).items() if d == c}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_stages(spark, tmp_path, tokenizer, scale):
    sf = f"/root/testdata/{scale}"
    docs = read(spark, sf, "documents")
    columns = docs.columns
    inputs = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == len(pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        inputs.append(docs)
        docs = spark.read.parquet(str(tmp_path / str(k)))
    rows = [[(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()] for x in inputs]
    # Quality: the base test and the learned list, from statistics counted here.
    labels = read(spark, sf, "labels")
    judged = quality_rules.judge(inputs[0], labels).select("rules").first()[0]
    rules = [[parse(c) for c in rule.split(" and ")] for rule in judged.split("; ")] if judged else []
    assert Counter(rows[1]) == Counter((d, t) for d, t in rows[0] if not features(t)[5] and not rejected(t, rules))
    near = brute_near(rows[1])
    assert Counter(rows[2]) == Counter((d, t) for d, t in rows[1] if d in near)
    # Suffix dedup: the remaining bytes; a text that loses none stays as it is, and a character cut in two goes.
    cut = Counter((d, t.decode() if kept == t else kept.decode(errors="ignore")) for d, t, kept, *_ in brute_kept([(d, (t or "").encode()) for d, t in rows[2]]))
    assert Counter((d, t or "") for d, t in rows[3]) == cut and any(len(t or "") for _, t in rows[3])
    # Mixing: the words of the shards' blocks, from streams packed here.
    given = Counter()
    for (_, d, _), n in brute_mix(inputs[3], mixing.mix_slots(inputs[3]).collect(), mixing.BLOCK_WORDS).items():
        given[d] += n
    taken = Counter()
    for d, t in rows[4]:
        taken[d] += len(WORD.findall(t))
    assert taken == given
    _, own = tokenizer
    want = Counter((d, sha(",".join(map(str, own.encode_ordinary(t)))), sha(t)) for d, t in rows[4])
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in docs.collect()) == want
    assert pipeline.run(spark, sf).count() == docs.count()


def parse(text):
    name, sign, number = text.split()
    return quality_rules.Condition(name, sign == ">=", float(number))


def test_stages_on_awkward_rows(spark, docs, empty, sf):
    """Nulls, repeats, very long texts, clashing columns and an empty table pass through every stage."""
    for start in (docs, empty):
        at = start
        for k, (_, stage) in enumerate(pipeline.STAGES):
            at = spark.createDataFrame(stage(spark, at, sf).collect(), stage(spark, at, sf).schema)
            assert k == len(pipeline.STAGES) - 1 or at.columns == docs.columns
        assert at.count() == 0 or start is docs
