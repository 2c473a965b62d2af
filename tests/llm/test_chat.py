"""Round trip of chat formatting."""

import hashlib
import random

from pyspark.sql import functions as F

from loadcast.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def check(spark, rows):
    turns = spark.createDataFrame(rows, SCHEMA)
    formatted = chat.format_chats(turns).withColumn("turns", chat.read_turns(F.col("formatted")))
    want = plain(rows)
    got = {r.conv_id: r for r in formatted.collect()}
    assert set(got) == set(want)
    for conv, r in got.items():
        assert [(t.role, t.text) for t in r.turns] == want[conv]
        learned = "".join(r.formatted[s.low : s.high] for s in r.loss_spans)
        assert len(r.loss_spans) == sum(role == "assistant" for role, _ in want[conv])
        blocks = r.formatted.count(chat.START)
        assert blocks == sum(i == 0 or want[conv][i - 1][0] != role for i, (role, _) in enumerate(want[conv]))
        assert chat.START not in learned and "[INST]" not in r.formatted and "</s>" not in r.formatted
    digest = {r.conv_id: r for r in chat.chat_digest(turns).collect()}
    for conv, told in want.items():
        assert digest[conv].n_turns == len(told)
        assert digest[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in told).encode()).hexdigest()
        learned = "".join(t for r, t in told if r == "assistant")
        assert (digest[conv].loss_chars, digest[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_forged_control_strings(spark):
    parts = ["<|start|>", "<|end|>", "<|next|>", "<|text|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<\\|", "<\\\\|start|>", "[\\INST]", "<", "|", "é𝄞", "\n", "a "]
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "assistant", "system", "<|end|>", "a\nb"])
            rows.append((conv, turn, role, "".join(rng.choices(parts, k=rng.randint(0, 7)))))
    check(spark, rows)


def test_edges(spark):
    rows = [
        (1, 0, "user", None),
        (1, 0, "user", None),
        (1, None, None, ""),
        (None, 1, "assistant", "x"),
        (2, 5, "assistant", "y" * 100_000),
        (2, 5, "assistant", "z"),
        (3, 1, "", ""),
    ]
    check(spark, rows + [(4, i, "assistant" if i % 3 else "user", f"t{i}") for i in range(700)])
    assert chat.chat_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'p' as parts", "1 as turns", "2 as head")
    assert chat.chat_digest(more).count() == 4
