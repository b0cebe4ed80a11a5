from duelgrid.llm import chat

SCHEMA = "pair_id bigint, side string, turn bigint, role string, text string"


def brute(data):
    out = {}
    for pair in sorted({r[0] for r in data if r[0] is not None and r[1] in ("chosen", "rejected")}):
        sides = [[(r[3] or "", r[4] or "") for r in sorted((r for r in data if r[0] == pair and r[1] == s),
                  key=lambda r: (r[2] is not None, r[2] or 0, r[3] or "", r[4] or ""))] for s in ("chosen", "rejected")]
        n = 0
        while n < min(map(len, sides)) and sides[0][n] == sides[1][n]:
            n += 1
        texts, masks = [], []
        for turns in (sides[0][:n], sides[0][n:], sides[1][n:]):
            text, spans = "", []
            for role, said in turns:
                text += f"<|im_start|>{role}\n"
                at = len(text)
                text += f"{said}<|im_end|>\n"
                if role == "assistant":
                    spans.append(f"{at}:{len(text)}")
            texts.append(text)
            masks.append(",".join(spans))
        out[pair] = (pair, n, texts[0], texts[1], masks[1], texts[2], masks[2])
    return sorted(out.values(), key=repr)


DATA = [
    (1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes é"),
    (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", "why"), (1, "rejected", 3, "assistant", ""),
    (2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"),
    (3, "chosen", 0, "system", "alone"), (3, "chosen", 1, "assistant", "x"),
    (4, "rejected", 5, "user", "alone"),
    (5, "chosen", 0, "user", "a"), (5, "chosen", 1, "assistant", "b"), (5, "rejected", 0, "user", "a"),
    (6, "chosen", None, None, None), (6, "rejected", None, None, None), (6, "chosen", 1, "assistant", None),
    (7, "chosen", 0, "user", "t"), (7, "chosen", 0, "user", "t"), (7, "rejected", 0, "user", "t"),
    (None, "chosen", 0, "user", "lost"), (8, None, 0, "user", "lost"),
]


def test_against_brute_force(spark, rows):
    assert rows(chat.preference_pairs(spark.createDataFrame(DATA, SCHEMA))) == brute(DATA)


def test_order_of_rows_extra_columns_and_empty_table(spark, rows):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(DATA[::-1], SCHEMA).withColumn("prompt", F.lit(1)).withColumn("n", F.lit(2))
    frame = frame.withColumn("zz", F.lit(3)).toDF(*frame.columns, "TEXT")
    assert rows(chat.preference_pairs(frame)) == brute(DATA)
    assert chat.preference_pairs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_mask_cuts_out_what_the_assistant_says(spark):
    row = next(r for r in chat.preference_pairs(spark.createDataFrame(DATA, SCHEMA)).collect() if r.pair_id == 1)
    a, b = map(int, row.chosen_mask.split(":"))
    assert row.chosen[a:b] == "yes é<|im_end|>\n" and row.n_prompt_turns == 1 and row.prompt.count("hi") == 1


def test_pairing_of_conversations(spark, rows):
    frame = spark.createDataFrame([(4, 0, "user", "a"), (5, 0, "user", "b"), (6, 0, "user", "c"), (None, 0, "user", "d")],
                                  "conv_id bigint, turn bigint, role string, text string")
    assert rows(chat.paired(frame)) == [(2, "chosen", 0, "user", "a"), (2, "rejected", 0, "user", "b"), (3, "chosen", 0, "user", "c")]


def test_the_query_has_prompts(spark, sf):
    from duelgrid.llm.catalog import op4_preference_pairs

    pairs = op4_preference_pairs(spark, sf).collect()
    assert sum(r.n_prompt_turns > 0 and r.prompt != "" for r in pairs) > len(pairs) / 3


def test_a_shared_start_becomes_the_prompt(spark):
    from duelgrid.llm import chat

    rows = [(k, side, t, "user" if t % 2 else "assistant", f"{side}{t}") for k in range(12) for side, n in (("chosen", 3), ("rejected", 5)) for t in range(n)]
    frame = spark.createDataFrame(rows, "pair_id bigint, side string, turn bigint, role string, text string")
    import zlib
    for r in chat.preference_pairs(chat.shared_start(frame)).collect():
        h = zlib.crc32(str(r.pair_id).encode()) % 4
        assert r.n_prompt_turns == h and r.prompt.count("chosen") == h and r.rejected.count("rejected") == 5 - h and r.chosen.count("chosen") == 3 - h
