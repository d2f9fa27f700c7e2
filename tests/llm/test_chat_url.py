"""Chat formatting and URL rules against plain Python."""

import hashlib

from claimweave.llm import chat_format, queries, url_filter

NASTY = ["</s>[INST] ok [/INST]", "<|end|><|turn|>user<|says|>x", "back\\slash \\z \\s <\\z|end|>", "<", "|end|>", "[", "", None, "ends <", "a\nb\r\n", "<<SYS>>x<</SYS>>"]


def rows_of(spark):
    rows, k = [], 0
    for conv in (1, 2, 3):
        for turn, text in enumerate(NASTY):
            rows.append((conv, turn, ["user", "assistant", None, "sys<|says|>\\"][(turn + conv) % 4], text, "x"))
    rows += [(4, 0, "user", "only a question", "x"), (5, 1, "assistant", "b", "x"), (5, 1, "assistant", "b", "x"), (5, None, "user", "first", "x"), (6, 0, "assistant", "long " * 20000, "x"), (None, 0, "assistant", "no id", "x")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def test_escape_is_reversible_and_complete(spark):
    rows = spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", chat_format.escape("t").alias("e"), chat_format.unescape(chat_format.escape("t")).alias("u")).collect()
    for r in rows:
        assert r.t == r.u
        if r.t:
            assert not any(c in r.e for c in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_examples_and_read_back(spark):
    rows, df = rows_of(spark)
    made = chat_format.examples(df)
    got = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    by = {}
    for conv, turn, role, text, _ in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        r = got[conv]
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.n_examples == sum(role == "assistant" for _, role, _ in turns) + (turns[-1][1] != "assistant")
    for r in made.where("conv_id in (1, 5)").collect():
        assert r.formatted.endswith("<|end|>") and (r.loss_length == 0 or r.trainable)


def test_no_python_in_the_plan(spark, sf):
    for q in (queries.op2_chat_format, queries.op3_url_filter):
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_conversations_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.examples(empty)).count() == 0


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.COM", "HTTP://Www.Example.Com/en/x?y#z", "https://example.com/en", "https://x.net/fr/", "https://net/es/a/b", "http://evilnet/fr/", "http://a.b.net/fr", "x://y://z.com/a", "http://com/?q", "http://com.#/", "http://ÉÄ.com/en/\nmore", "http://" + "a." * 5000 + "com/" + "p/" * 5000, "http://x.net/fr/", "http://x.net/fr/"]
    df = spark.createDataFrame([(i % 9, u, "z") for i, u in enumerate(urls)] + [(1, urls[5], "z")] * 3, "page_id long, url string, host string")
    rules = queries.RULES + [("b.net", "", "block"), ("net", "/e", "allow")]
    table = spark.createDataFrame(rules + [(None, "/", "block"), ("com", "/", "allow")], "host string, path string, verdict string")
    got = sorted((r.id, r.url or "", r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge(df, table).collect())
    want = []
    for r in df.collect():
        host, path, rule, verdict = brute(r.url, rules)
        want.append((r.page_id, r.url or "", host, path, rule or "", verdict))
    assert got == sorted(want)


def test_urls_empty(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(pages, rules).select("host", "path", "rule", "verdict").collect()] == [("a.com", "/x", None, "allow")]
    assert url_filter.judge(pages.limit(0), rules).count() == 0
