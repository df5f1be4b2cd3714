import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n))


def odd_texts():
    """Nulls, blanks, ties, repeats, very long and non-Latin texts."""
    import random

    rng = random.Random(7)
    base = sentence(rng, 120)
    near = base.split()
    near[5] = "changed"
    passage = sentence(rng, 60)
    return [
        None, "", "  \n\t ", "one", "one two three four", "one two three four", "One TWO three\x0bfour five", base, base, " ".join(near), base.upper(),
        "x\n" + passage + "\ny" + sentence(rng, 30), sentence(rng, 40) + "\n" + passage, passage, "日本語のテキスト" * 30, "日本語のテキスト" * 30 + "終", "é" * 60 + "è", "z" + "é" * 60,
        "ab " * 400, "ab " * 300, "#*$ %&| " * 40, sentence(rng, 30000), "tail\n\n\nline\nline\n", " nbsp　wide " * 10, "<|im_start|>user\\n<\\|x\\\\|",
    ]


@pytest.fixture(scope="session")
def texts():
    return odd_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The odd texts, a repeated row, a repeated id, a null id, and extra columns with clashing names."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "_k", "key", "v", "rep", "digest"]
    rows = [(i, t, "en", ["b", "a", None][i % 3], len(t or ""), "x", 1, "v", 2, "d") for i, t in enumerate(texts)]
    rows += [rows[8], (3, "another text under a used id", "en", "a", 5, "x", 1, "v", 2, "d"), (None, "no id here", "en", "b", 5, "x", 1, "v", 2, "d")]
    schema = ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'int' if n in ('key', 'rep') else 'string'}" for n in names)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def tokenizer():
    import base64

    import public_tokenizers as p
    import tiktoken

    from pagelens.llm.queries import VOCABULARY

    path = p.path(VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
