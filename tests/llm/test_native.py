from __future__ import annotations

import datetime
import hashlib
import json
import math
import re

import pytest
import regex
from pyspark.sql import functions as F

from sillage.llm import chat, pii, queries, sketch, urls
from sillage.llm.queries import PII_KEY, op5_chat, op6_pii, op9_sketch

SF = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += (d * 2 - 9 * (d > 4)) if i % 2 else d
    return total % 10 == 0


def plain_feistel(value, a, b, key, tag):
    left, right = divmod(value, b)
    m, n = a, b
    for i in range(1, pii.ROUNDS + 1):
        noise = int(hashlib.sha256(f"{key}|{tag}|{i}|{right}".encode()).hexdigest()[:14], 16)
        left, right, m, n = right, (left + noise) % m, n, m
    return left * b + right


@pytest.mark.parametrize(("a", "b"), [(5, 7), (10, 10), (1, 9), (75, 487)])
def test_feistel_is_the_keyed_permutation(spark, a, b):
    out = spark.range(a * b).select("id", pii.feistel(F.col("id"), a, b, "k", "t").alias("x")).collect()
    assert {r["id"]: r["x"] for r in out} == {i: plain_feistel(i, a, b, "k", "t") for i in range(a * b)}
    assert {r["x"] for r in out} == set(range(a * b))


TEXT = 'é.34@mail7.example.com or 4111-1111-1111-1111, not 4111111111111112; +1 (017) 555-7713 at 1.43.173.185. and 300.1.1.1, 2024-02-29 31.12.1999 12/31/1999 2023-02-30 078-05-1120 "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"'


def test_pii_formats_and_links(spark):
    rows = [(1, TEXT, "x"), (2, f"{TEXT} {TEXT}", "x"), (3, None, None), (4, "", "x"), (5, "nothing here", "x"), (None, TEXT, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_kinds string")
    out = {r["doc_id"]: r for r in pii.mask(df, "secret").collect()}
    one = out[1]["text"]
    assert out[2]["text"] == f"{one} {one}" and out[None]["text"] == one
    assert out[3]["text"] is None and out[3]["pii_kinds"] == [] and out[4]["text"] == "" and out[5]["text"] == "nothing here"
    assert out[1]["pii_kinds"] == ["email", "card", "phone", "ip", "date", "date", "date", "ssn", "secret"]
    for kept in ("4111111111111112", "300.1.1.1", "2023-02-30"):
        assert kept in one
    for gone in ("mail7", "4111-1111-1111-1111", "017", "1.43.173.185", "2024-02-29", "31.12.1999", "12/31/1999", "078-05-1120", "2abc3ff2"):
        assert gone not in one
    card = re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", one)[0].replace("-", "")
    assert luhn(card)
    assert all(int(p) < 256 for p in re.search(r"at (\d+\.\d+\.\d+\.\d+)\. and", one)[1].split("."))
    first, second = re.search(r"(\d\d\.\d\d\.\d{4}) (\d\d/\d\d/\d{4})", one).groups()
    assert first.split(".")[::-1] == [second.split("/")[2], second.split("/")[0], second.split("/")[1]]
    assert pii.mask(df, "other").filter("doc_id = 1").first()["text"] != one
    assert pii.mask(df.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        pii.mask(df, "")


def test_pii_query_leaves_no_valid_value(spark):
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    after = {r["doc_id"]: r for r in op6_pii(spark, SF).collect()}
    assert before.keys() == after.keys() and PII_KEY
    for key, text in before.items():
        got = after[key]["text"]
        for value in re.findall(r"[\w.]+@[\w.]+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|\b[0-9a-f]{40}\b", text) + [m for m in re.findall(r"(?<!\d)\d{16}(?!\d)", text) if luhn(m)]:
            assert value not in got
        if after[key]["n_replaced"] == 0:
            assert got == text


def plain_digits(digits, key, tag):
    half = len(digits) // 2
    return digits if len(digits) < 2 else str(plain_feistel(int(digits), 10 ** (len(digits) - half), 10**half, key, tag)).zfill(len(digits))


def refill(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def plain_value(kind, m, key):
    """One value's pseudonym, or None if it fails its check; written from the formats, one value at a time."""
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        return f"user{hashlib.sha256(f'{key}|email|{m.lower()}'.encode()).hexdigest()[:16]}@mail.invalid"
    if kind == "secret":
        new = hashlib.sha256(f"{key}|secret|{m}".encode()).hexdigest()[: len(m)]
        return (new.upper() if re.search("[A-F]", m) else new) if re.search("[0-9]", m) and re.search("[A-Fa-f]", m) else None
    national = lambda x: str(plain_feistel(int(x) - 2 * 10**9, 800_000, 10_000, key, "phone1") + 2 * 10**9)
    if kind == "phone":
        two = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
        code = d[:1] if d[0] in "017" else d[:2] if d[:2] in two else d[:3]
        rest = d[len(code) :]
        return refill(m, code + (national(rest) if code == "1" and len(rest) == 10 and rest[0] in "23456789" else plain_digits(rest, key, "phone"))) if 8 <= len(d) <= 15 else None
    if kind == "local_phone":
        return refill(m, national(d))
    if kind == "date":
        parts = [int(x) for x in re.split(r"[-./]", m)]
        y, mo, day = parts if "-" in m else (parts[2], parts[1], parts[0]) if "." in m else (parts[2], parts[0], parts[1])
        try:
            then = datetime.date(y, mo, day)
        except ValueError:
            return None
        if y < 100:
            return None
        first = datetime.date(y // 100 * 100, 1, 1)
        a, b = (75, 487) if y // 100 % 4 == 0 else (92, 397)
        new = first + datetime.timedelta(plain_feistel((then - first).days, a, b, key, "date"))
        return f"{new.year:04d}-{new:%m-%d}" if "-" in m else f"{new:%d.%m.}{new.year:04d}" if "." in m else f"{new:%m/%d/}{new.year:04d}"
    if kind == "ssn":
        a, g, n = (int(x) for x in m.split("-"))
        if not (0 < a < 900 and a != 666 and g and n):
            return None
        x = plain_feistel(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1, 898 * 99, 9999, key, "ssn")
        place = x // 9999 // 99
        return f"{place + 1 + (place >= 665):03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"
    if kind == "ip":
        parts = [int(x) for x in m.split(".")]
        if max(parts) > 255:
            return None
        n = plain_feistel(int.from_bytes(bytes(parts)), 65536, 65536, key, "ip")
        return ".".join(str(b) for b in n.to_bytes(4))
    if kind == "card":
        if not luhn(d) or not d.strip("0"):
            return None
        body = plain_digits(d[:-1], key, "card")
        return refill(m, body + next(c for c in "0123456789" if luhn(body + c)))
    plain = m.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = re.sub("[^0-9]", "", plain[4:])
    half = (len(body) + 1) // 2
    moved = plain_digits(body[:half], key, "iban") + plain_digits(body[half:], key, "iban2")
    check = f"{98 - number(refill(plain[4:], moved) + plain[:2] + '00') % 97:02d}"
    return plain[:2] + refill(m[2:], check + moved)


def plain_mask(text, key):
    kinds = []
    order = ["email", "secret", "phone", "local_phone", "date", "ssn", "ip", "card", "iban"]

    def one(m):
        kind = next(k for k in order if regex.fullmatch(pii.PATTERNS[k], m[0], flags=regex.ASCII if k != "email" else 0))
        new = plain_value(kind, m[0], key)
        kinds.extend([kind] * (new is not None))
        return m[0] if new is None else new

    return regex.sub("|".join(f"(?:{pii.PATTERNS[k]})" for k in order), one, text), kinds


MORE = "call 555-123-4567 or (555) 223-4567, IBAN GB82 WEST 1234 5698 7654 32; DE89370400440532013000 and DE88370400440532013000, 155-223-4567"


def test_pii_query_equals_a_plain_computation(spark):
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    after = op6_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(after) == len(before)
    for r in after:
        text, kinds = plain_mask(before[r["doc_id"]] or "", PII_KEY)
        assert r["text"] == (text if before[r["doc_id"]] is not None else None)
        assert r["n_replaced"] == len(kinds) and all(r[f"n_{k}"] == kinds.count(k) for k in pii.KINDS)


def test_national_phones_and_account_numbers(spark):
    df = spark.createDataFrame([(1, MORE), (2, f"x {MORE}")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.mask(df, "k").collect()}
    assert out[1]["text"] == plain_mask(MORE, "k")[0] and out[2]["text"] == "x " + out[1]["text"]
    assert out[1]["pii_kinds"] == ["local_phone", "local_phone", "iban", "iban"]
    assert "DE88370400440532013000" in out[1]["text"] and "155-223-4567" in out[1]["text"]
    found = re.findall(r"[A-Z]{2}\d\d(?: ?[0-9A-Z]{4})+(?: ?[0-9A-Z]{1,3})?", out[1]["text"])[:2]
    for value in found:
        plain = value.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_phones_are_linked_across_spellings(spark):
    same = [["+49 30 1234567", "+49301234567", "+49-30-123-4567", "+49 (30) 123 4567"], ["+1 555 123 4567", "(555) 123-4567", "555-123-4567", "+15551234567", "+1 (555) 123-4567"], ["+421 259 491 111", "+421259491111"], ["+7 495 123 45 67", "+74951234567"]]
    rows = [(i, f"call {x} now") for i, group in enumerate(same) for x in group]
    found = {}
    for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect():
        assert len(r["pii_kinds"]) == 1, r
        digits = re.sub("[^0-9]", "", r["text"])
        found.setdefault(r["doc_id"], set()).add("1" + digits if r["pii_kinds"] == ["local_phone"] else digits)
    assert all(len(x) == 1 for x in found.values()) and len(set.union(*found.values())) == len(same)
    heads = [next(iter(found[i])) for i in range(4)]
    assert heads[0].startswith("49") and heads[1].startswith("1") and heads[2].startswith("421") and heads[3].startswith("7")
    assert all(h not in re.sub("[^0-9]", "", "".join(g)) for h, g in zip(heads, same, strict=True))


def test_a_key_column_stays_out_of_the_plan(spark):
    secret = spark.createDataFrame([("k",)], "secret_value string")
    docs = spark.createDataFrame([(1, MORE)], "doc_id long, text string")
    masked = pii.mask(docs.crossJoin(F.broadcast(secret)), F.col("secret_value")).drop("secret_value")
    assert masked.first()["text"] == plain_mask(MORE, "k")[0]


def test_dates_stay_in_their_century_and_form_a_permutation(spark):
    days = spark.sql("select explode(sequence(date'1900-01-01', date'1999-12-31')) as d").select(F.date_format("d", "yyyy-MM-dd").alias("text"))
    out = pii.mask(days, "k").select("text").distinct()
    assert out.count() == 36524 and out.filter("text < '1900-01-01' or text > '1999-12-31'").count() == 0


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_sketches_estimate_resemblance(spark):
    words = [f"w{i}" for i in range(2000)]
    rows = [("", ""), ("a b", "A\tB"), ("a b c d e f", "a b c d e g"), (" ".join(words[:1000]), " ".join(words[:750] + words[1500:1750])), (None, "x")]
    df = spark.createDataFrame(rows, "a string, b string").select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    out = df.select(sketch.resemblance(F.col("a"), F.col("b")).alias("r"), sketch.containment(F.col("a"), F.col("b")).alias("c"), sketch.distinct(F.col("a")).alias("n"), F.size("a").alias("k")).collect()
    assert [r["r"] for r in out[:3]] == [1.0, 1.0, pytest.approx(1 / 3)] and out[4]["r"] == 0.0
    assert abs(out[3]["r"] - 746 / 1246) < 0.15 and abs(out[3]["c"] - 0.75) < 0.2 and abs(out[3]["n"] - 996) < 250
    assert [r["k"] for r in out] == [0, 1, 2, 128, 0]


def test_sketches_merge(spark):
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:1500]), " ".join(words[1496:])
    row = spark.createDataFrame([(a, b, " ".join(words))], "a string, b string, c string").select(sketch.merge(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))).alias("m"), sketch.sketch(F.col("c")).alias("c")).first()
    assert row["m"] == row["c"]


def test_sketch_query_equals_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in op9_sketch(spark, SF).collect()}
    shingles = []
    for i, (key, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        moved = len(text) // 4
        edited = text[: len(text) - moved] + following[:moved]
        assert got[key]["n_chars"] == len(text) and got[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sets = []
        for t in (text, edited, following):
            w = plain_words(t)
            sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
        for other, name in ((sets[1], "near_edited"), (sets[2], "near_next")):
            true = len(sets[0] & other) / len(sets[0] | other)
            shingles.append(abs(got[key][name] - true))
            assert abs(got[key][name] - true) < 0.25
    assert sum(shingles) / len(shingles) < 0.03
    same = {}
    for key, text in docs:
        assert same.setdefault(text, got[key]["fingerprint"]) == got[key]["fingerprint"]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_next_document_over_runs(spark, parts):
    ids = [None, 3, 3, 5, 8, 13, 21, 22, 23, 40, 41]
    df = spark.createDataFrame([(i, f"t{i}{k}", "x") for k, i in enumerate(ids)], "doc_id long, text string, next_text string").repartition(4)
    out = sketch.with_next(df, parts=parts).collect()
    assert len(out) == len(ids)
    follows = {r["text"]: r["next_text"] for r in out}
    start = "tNone0"
    seen, at = [], start
    for _ in ids:
        seen.append(at)
        at = follows[at]
    assert at == start and len(set(seen)) == len(ids)
    assert seen[3:8] == ["t53", "t84", "t135", "t216", "t227"]
    assert sketch.with_next(df.limit(0), parts=parts).count() == 0


def test_host_and_path(spark):
    cases = [("http://A.Example.com/x?y", "a.example.com", "/x"), ("x", "", ""), (None, "", ""), ("http://a", "a", ""), ("a://b?c://d/e", "b", ""), ("HTTPS://u@H:80/p/#f", "u@h:80", "/p/"), ("p://h\n/q\n", "h\n", "/q\n")]
    df = spark.createDataFrame(cases, "url string, h string, p string")
    bad = df.filter(~urls.host_of(F.col("url")).eqNullSafe(F.col("h")) | ~urls.path_of(F.col("url")).eqNullSafe(F.col("p")))
    assert bad.count() == 0


def test_longest_rule_wins_and_no_token_is_missed(spark):
    rules = [urls.HostRule("allow", "com"), urls.HostRule("block", "example.com", "/en"), urls.HostRule("allow", "www.example.com", "/en/"), urls.PatternRule("block", r"xx+", ()), urls.PatternRule("block", r"/bad/", ("bad",)), urls.PatternRule("allow", r"/bad/but/good", ("good",))]
    cases = {
        "http://example.com/english": ("example.com/en", "block"),
        "http://a.www.example.com/en/1": ("www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("com/", "allow"),
        "http://h.com": (None, "allow"),
        "http://h.org/axxb": (None, "block"),
        "http://h.org/bad/1": (None, "block"),
        "http://h.org/bad/but/good": (None, "allow"),
        None: (None, "allow"),
        "nothing": (None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*cases, None, "http://h.org/bad/1"])], "page_id int, url string, rule string")
    out = urls.filter_urls(df, rules).collect()
    assert len(out) == len(cases) + 2
    for r in out:
        assert (r["rule"], r["verdict"]) == cases[r["url"]]
    assert urls.filter_urls(df.limit(0), rules).count() == 0
    assert urls.filter_urls(df, []).filter("verdict <> 'allow'").count() == 0


HARD = [r"\### Assistant: </turn> ok", "</turn>\n<turn role=\"user\">x", r"<\turn <\\/turn <<turn", "", "\\", "a\n</turn>\n", 'é😀"<&lt;']


def test_chat_round_trip(spark):
    rows = [(1, i, role, t) for i, (role, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "assistant", 'o"d<d&'], HARD, strict=True))]
    rows += [(2, 0, None, None), (None, 0, "assistant", "x"), (3, None, "user", "q"), (3, 1, "human", "z")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r["key"]: r for r in chat.parse_chats(chat.format_chats(chat.turns_from_table(df, key="conv_id"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_mask"))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r[2], r[3]) for r in rows[:7]]
    assert out[1]["loss"] == "".join(r[3] for r in rows[:7] if r[2] == "assistant")
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("", "")] and out[None]["loss"] == "x"
    assert [t["role"] for t in out[3]["turns"]] == ["user", "human"]
    for span in out[1]["loss_mask"]:
        piece = out[1]["formatted"][span["start"] : span["start"] + span["length"]]
        assert piece == re.sub(r"<(\\*)(/?turn)", r"<\\\1\2", rows[span["turn"] - 1][3])
    assert chat.format_chats(chat.turns_from_table(df.limit(0), key="conv_id")).count() == 0


def test_layouts_are_chosen_by_fingerprint(spark):
    records = [
        '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "source": "x"}',
        '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}',
        '{"prompt": "a", "response": "b"}',
        '{"instruction": "a", "output": "b"}',
        '{"instruction": "a", "input": "c", "output": "b"}',
        '{"question": "a", "answer": "b", "id": 3}',
        '{"other": 1}',
        "no json",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(records)), "id int, payload string")
    turns = chat.turns_from_json(df, payload="payload", key="id").collect()
    by = {}
    for r in sorted(turns, key=lambda r: (r["key"], r["turn"] or 0)):
        by.setdefault(r["key"], []).append((r["layout"], r["role"], r["text"]))
    for k, name in ((0, "messages"), (1, "conversations"), (2, "prompt_response"), (3, "instruction"), (5, "question_answer")):
        assert by[k] == [(name, "user", "a"), (name, "assistant", "b")]
    assert by[4] == [("instruction_input", "user", "a\n\nc"), ("instruction_input", "assistant", "b")]
    assert by[6] == by[7] == by[8] == [(None, None, None)]
    with pytest.raises(ValueError):
        chat.layout_of(df)


def test_fingerprints_are_of_the_records_own_paths(spark):
    records = {'{"prompt": "a", "response": "b", "zzz": 1}': ("prompt", "response"), '{"prompt": "a", "response": "b", "text": "t"}': ("prompt", "response", "text"), '{"messages": [{"role": "r", "content": "c", "x": 1}]}': ("messages[].role", "messages[].content"), '{"zzz": 1}': ()}
    df = spark.createDataFrame([(r,) for r in records], "p string").select("p", chat.json_fingerprint(F.col("p")).alias("f"))
    assert {r["p"]: r["f"] for r in df.collect()} == {r: chat.fingerprint(paths) for r, paths in records.items()}
    # the map has each mapping's own paths and those with one more; only what is not in it is compared
    assert chat.JSON_BY_FINGERPRINT[chat.fingerprint(("prompt", "response", "text"))].name == "prompt_response"
    more = ("prompt", "response", "text", "question")
    assert chat.fingerprint(more) not in chat.JSON_BY_FINGERPRINT and chat.contained(more).name == "prompt_response"
    assert all(chat.contained(x.paths()) == x for x in chat.LAYOUTS)


def test_chat_query_passes_through_every_kind_of_layout(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    seen = []
    real = chat.turns_from_json
    chat.turns_from_json = lambda *a, **k: seen.append(made := real(*a, **k)) or made
    try:
        turns = queries._chat_turns(rows)
    finally:
        chat.turns_from_json = real
    used = {r["layout"] for r in seen[0].select("layout").distinct().collect()}
    assert used == {"messages", "conversations", "dialog", "prompt_response", "instruction"}
    assert turns.select("key").distinct().count() == rows.select("conv_id").distinct().count() and turns.count() == rows.count()
    odd = spark.createDataFrame([(k, 0, "robot", "x") for k in range(20)] + [(k, 1, None, None) for k in range(20)], "conv_id long, turn long, role string, text string")
    assert queries._chat_turns(odd).count() == 40 and {r["role"] for r in queries._chat_turns(odd).collect()} == {"robot", ""}


def test_further_fields_do_not_change_the_layout(spark):
    records = {
        '{"prompt": "a", "response": "b", "text": "z"}': "prompt_response",
        '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "system": "s"}': "messages",
        '{"instruction": "a", "output": "b", "question": "q"}': "instruction",
        '{"instruction": "a", "input": "c", "output": "b", "prompt": "p"}': "instruction_input",
        '{"prompt": "a", "completion": "b", "answer": "c"}': "prompt_completion",
    }
    df = spark.createDataFrame(list(enumerate(records)), "id int, payload string")
    got = {(r["key"], r["layout"]) for r in chat.turns_from_json(df, payload="payload", key="id").select("key", "layout").collect()}
    assert got == set(enumerate(records.values()))
    wide = spark.createDataFrame([(1, 0, "human", "a", "x", "y", "z")], "conv_id long, turn long, role string, text string, input string, prompt string, output string")
    assert [(r["role"], r["text"]) for r in chat.turns_from_table(wide, key="conv_id").collect()] == [("human", "a")]
    assert chat.layout_of(spark.createDataFrame([("a", "b", "c")], "prompt string, response string, system string")).name == "prompt_response"


def test_mixed_layouts_come_back_from_the_formatted_text(spark):
    made = [
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": HARD[1]}, {"role": "assistant", "content": HARD[2]}], "n": 1},
        {"conversations": [{"from": "human", "value": HARD[0]}, {"from": "gpt", "value": ""}]},
        {"dialog": [{"speaker": "user", "text": "é"}]},
        {"system": "s", "instruction": HARD[5], "output": "b", "id": 9},
        {"instruction": "a", "input": "c", "output": HARD[6]},
        {"question": "a", "answer": None},
    ]
    want = [
        [("system", "s"), ("user", HARD[1]), ("assistant", HARD[2])],
        [("user", HARD[0]), ("assistant", "")],
        [("user", "é")],
        [("system", "s"), ("user", HARD[5]), ("assistant", "b")],
        [("user", "a\n\nc"), ("assistant", HARD[6])],
    ]
    df = spark.createDataFrame([(i, json.dumps(m), "clash") for i, m in enumerate(made)], "id long, payload string, layout string")
    turns = chat.turns_from_json(df, payload="payload", key="id")
    read = chat.parse_chats(chat.format_chats(turns.filter("layout is not null"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_mask")))
    got = {r["key"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in read.collect()}
    assert got == {i: (w, "".join(t for r, t in w if r == "assistant")) for i, w in enumerate(want)}


def test_chat_query_has_the_extra_conversation(spark):
    row = op5_chat(spark, SF).filter("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text) and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert not math.isnan(row["formatted_chars"])
