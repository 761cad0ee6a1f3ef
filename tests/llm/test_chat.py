import hashlib
import random

from framewright.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def want(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha(said), len(loss), sha(loss)


def read(spark, rows, **options):
    f = chat.format_conversations(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), **options)
    assert f.columns == ["conv_id", "formatted", "loss_spans"]
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(f).collect()}, {r.conv_id: r.formatted for r in f.collect()}


def test_round_trip_of_hostile_texts(spark):
    random.seed(15)
    pieces = ["\\", "<", ">", "|", "</>", "<+>", "<|user>", "\\l", "\\b", "\n", "é", "中\U0001f600", "", " ok", "### Assistant:", "</turn>"]
    rows, by = [], {}
    for c in range(60):
        for t in range(random.randint(1, 9)):
            role, text = random.choice(["user", "assistant", "system", "a<b>\\|"]), "".join(random.choice(pieces) for _ in range(random.randint(0, 6)))
            rows.append((c, t, role, text))
            by.setdefault(c, []).append((role, text))
    random.shuffle(rows)
    for chunk in (256, 2):  # stretches leave no trace
        digests, formatted = read(spark, rows, chunk_turns=chunk)
        assert digests == {c: want(t) for c, t in by.items()}
        if chunk == 256:
            whole = formatted
    assert formatted == whole


def test_adjacent_turns_share_a_header(spark):
    _, f = read(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")])
    assert f[1] == "<|user>a<+>b</><|assistant>c</>"


def test_edges(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"), (None, 3, "user", "lost"), (2, 5, "assistant", "y" * 200000)]
    digests, _ = read(spark, rows)
    assert digests == {1: want([("user", "first"), ("", ""), ("assistant", "x"), ("assistant", "x")]), None: want([("user", "lost")]), 2: want([("assistant", "y" * 200000)])}
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
