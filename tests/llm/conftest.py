import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    """Random documents with copies, near copies, shared passages and lines, junk, nulls and a long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeêñ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, boiler = say(45), "Released under License 2.0 by X"
    rows = []
    for i in range(n):
        text = "\n".join(say(r.randint(3, 40)) for _ in range(r.randint(1, 6)))
        if i % 6 == 1:
            text += "\n" + boiler.replace("2.0", f"{i}.0") + "\n" + say(9)
        if i % 7 == 2:
            text = say(5) + " " + passage + " " + say(r.randint(0, 4))
        if i % 9 == 4:
            text = rows[i - 3][1] or ""
        if i % 9 == 5 and rows[i - 2][1]:
            text = rows[i - 2][1] + "!"
        if i % 10 == 8:
            text = "\n".join("SHOUT!! " * 8 + "$$$ ||| ***" for _ in range(4))
        rows.append((i, text, "en", f"src{i % 4}" if i % 11 else None, len(text)))
    rows += [(100, None, None, None, None), (101, "", "en", "src1", 0), (102, " \t\n \x0b", "en", "src1", 5), (103, "A b\x1cC  d", "en", "src2", 8), (104, say(30000), "en", "src3", 1), (7, rows[7][1], "en", "src3", 1), (None, say(50), "en", "src0", 1), (None, None, None, "src0", None)]
    return rows


def dialogues(seed: int = 11, n: int = 120) -> list[tuple]:
    """Random conversations: odd roles, nulls, repeats, turns with one number, and a long one."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(r.randint(1, 9) if c != 5 else 60):
            role = r.choice(("user", "assistant")) if r.random() < 0.4 else ("user", "assistant")[turn % 2]
            role = r.choice(("system", "tool", "", None, "User", "ünder")) if r.random() < 0.12 else role
            text = r.choice(("yes.", "no", "why?", "well\n", " \t", "", "a. b", "ja! \x0b", "é.", None, f"{c} {turn}."))
            rows.append((c if c != 9 else None, None if r.random() < 0.05 else turn + (turn > 3) * (c % 3), role, text))
    return rows + [(1000 + i, 0, "user", "all alone.") for i in range(60)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def turns():
    return dialogues()


@pytest.fixture(scope="session")
def sf_dir(spark, rows, turns, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(3)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(turns, TURNS).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    labels = [(i, 0 if i % 10 == 8 else 1, 0) for i in range(60)] + [(None, 1, 0), (3, None, None), (999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [r.gauss(0, 1) for _ in range(64)], 0) for i in range(301)] + [(400, None, 0), (None, [1.0] * 64, 0)]
    vectors += [(500 + i, vectors[0][1], 0) for i in range(30)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], TURNS).write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder
