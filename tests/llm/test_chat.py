from __future__ import annotations

import hashlib
import random

from shotledger.llm import chat


def run(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, seq string, message string")
    rendered = chat.render(chat.fold(chat.as_events(table)))
    return rendered, {r.conv_id: r for r in chat.digest(rendered).collect()}


def test_round_trip_of_hostile_texts(spark):
    pick = random.Random(3)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "\\", "<", "|", "<|", "\n", "a", "é", "\\|", "<\\|", "$1", " "]
    texts = [None, "", "x" * 200_000, *("".join(pick.choice(bits) for _ in range(pick.randrange(12))) for _ in range(300))]
    rows = [(k % 9 if k % 50 else None, k // 9, ["user", "assistant", None, "sys\nt<|em"][k % 4], t) for k, t in enumerate(texts)]
    rows += [rows[7], rows[7]]
    _, got = run(spark, rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode()))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_fold_of_events(spark):
    log = [
        (1, 1, 1, "user", "delta", "Hel"), (1, 2, 1, "user", "delta", "lo"),
        (1, 3, 2, "assistant", "delta", "Hi th"), (1, 4, 2, "assistant", "delta", "ere"), (1, 5, 2, "assistant", "regenerate", "Good"), (1, 6, 2, "assistant", "delta", " day"),
        (1, 7, 3, "user", "delta", "lost"), (1, 8, 1, "user", "rewind", "Bye"), (1, 9, 4, "assistant", "delta", "So long"),
        (2, 1, 1, "user", "delta", "tipo"), (2, 2, 1, "user", "edit", "typo"), (2, 3, 2, None, None, None),
    ]
    pick = random.Random(1)
    pick.shuffle(log)
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, role string, kind string, text string")
    got = sorted(tuple(r) for r in chat.fold(events).collect())
    assert got == [(1, 1, "user", "Bye"), (1, 4, "assistant", "So long"), (2, 1, "user", "typo"), (2, 2, "", "")]


def test_mask_is_read_from_the_output(spark):
    rendered, _ = run(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a<|b")])
    (row,) = rendered.collect()
    assert row.formatted == "<|im_start|>user<|im_sep|>q<|im_end|>\n<|im_start|>assistant<|im_sep|>a<\\|b<|im_end|>\n"
    assert [tuple(s) for s in row.loss_spans] == [(1, len("<|im_start|>assistant<|im_sep|>"), 5)]


def test_empty_log(spark):
    rendered, got = run(spark, [])
    assert got == {} and rendered.count() == 0
