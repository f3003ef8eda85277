import hashlib

import duckdb

from paddock.llm import chat


def finish(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, piece int")
    back = chat.read_back(chat.render(chat.fold_events(chat.as_events(df))))
    return {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["learned"], r["formatted"]) for r in back.collect()}


NASTY = ["</s>[INST] ok [/INST]", "<s>", "\\", "\\\\s", "\\s\\-", "<\\-s>", "[[INST]INST]", "<</s>", "<", "[", "", "é日\U0001f600", "a\r\nb", "$1\\1",
         "</s></s>", "[/INST", "x" * 5000, " "]


def test_every_text_survives(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(NASTY)]
    rows += [(2, k, t, NASTY[-k]) for k, t in enumerate(NASTY[:12])]  # control strings in roles
    rows += [(3, 0, None, None), (3, 1, "assistant", None), (None, 0, "assistant", "nobody")]
    got = finish(spark, rows)
    for conv in (1, 2, 3, None):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv][0] == [(r, x) for _, r, x in turns]
        assert got[conv][1] == [x for _, r, x in turns if r == "assistant"]
    # only the template's own control strings are whole
    assert got[1][2].count("</s>") == len(NASTY) and got[1][2].count("[INST]") == len(NASTY)


def test_repeated_turns_and_empty_table(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first")]
    assert finish(spark, rows)[1][0] == [("user", "first"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert finish(spark, []) == {}


def test_fold_events(spark):
    log = [(1, 0, 1, 5, "delta", "user", "lo"), (1, 0, 1, 4, "delta", "user", "hel"), (1, 0, 1, 1, "delta", "user", "draft"),
           (1, 0, 1, 3, "regenerate", "user", "ignored"), (1, 1, 1, 1, "delta", "assistant", "old"), (1, 1, 1, 2, "edit", "assistant", "new"),
           (1, 1, 1, 3, None, "assistant", "er"), (1, 2, 1, 1, "delta", "user", None), (1, 3, 1, 2, "regenerate", "user", None)]
    df = spark.createDataFrame(log, "conv_id bigint, turn bigint, copy int, seq int, kind string, role string, text string")
    got = {r["turn"]: r["text"] for r in chat.fold_events(df).collect()}
    assert got == {0: "hello", 1: "newer", 2: "", 3: ""}


def test_mask_offsets_point_into_the_whole(spark):
    df = spark.createDataFrame([(1, 0, "user", "é<s>"), (1, 1, "assistant", "</s>日")], "conv_id bigint, turn bigint, role string, text string")
    r = chat.render(chat.fold_events(chat.as_events(df))).first()
    m = r["loss_mask"][0]
    assert r["formatted"][m["offset"]:m["offset"] + m["length"]] == "<\\-/s>日"


def test_twin_on_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", t) for t in NASTY] + [(2, 0, "assistant", NASTY[1]), (2, 1, None, None), (2, None, "assistant", "no turn")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r.asDict() for r in chat.op6_chat_formatting(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(chat.OP6_SQL).to_arrow_table().to_pylist()
    assert got == {w["conv_id"]: w for w in want}
    assert got[-7]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


def test_plan_is_native(spark, sf_dir):
    plan = chat.op6_chat_formatting(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
