"""Splitting, packing, leaks, defects, encodings."""

import base64
import random
import time
from collections import Counter

import pytest
from braidlog.llm import defects, encoding, leaks, packing, splitting
from hypothesis import given, settings
from hypothesis import strategies as st

# ---- splitting -----------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab .,\n#-`*é𝄞?!1"), max_size=600), st.integers(30, 120), st.integers(0, 20))
def test_pieces_cover_and_rebuild(text, limit, overlap):
    parts = splitting.pieces(text, limit, overlap)
    assert all(b - a <= limit and a <= own <= b for a, own, b in parts)
    assert splitting.rebuild((a, own, text[a:b]) for a, own, b in random.Random(1).sample(parts, len(parts))) == text
    for (_, _, stop), (start, own, _) in zip(parts, parts[1:]):
        assert own == stop and own - start == min(overlap, own)


def test_natural_borders():
    body = "".join(f"# Part {i}\n\n" + "A sentence of some length stands here. " * 12 + "\n\n" for i in range(6))
    cuts = [own for _, own, _ in splitting.pieces(body)][1:]
    assert cuts and all(body[c:].startswith("# Part") for c in cuts)
    prose = "One sentence follows another, and so on. " * 200
    assert all(prose[:own].endswith(". ") for _, own, _ in splitting.pieces(prose)[1:])
    fenced = "text\n```py\n# no heading\nx = 1\n```\nmore\n" * 80
    assert all(not fenced[own:].startswith("# no") for _, own, _ in splitting.pieces(fenced))


def test_headings_of_all_levels_and_nested_elements():
    deep = "".join(f"#### Four {i}\n\n" + "".join(f"##### Five {i}.{k}\n\n" + "Words of a part. " * 40 + "\n\n" for k in range(3)) for i in range(4))
    cuts = [own for _, own, _ in splitting.pieces(deep)][1:]
    assert cuts and all(deep[c:].startswith(("#### ", "##### ")) for c in cuts) and any(deep[c:].startswith("#### ") for c in cuts)
    page = "<body><ul>" + "".join(f"<li><p>{'item words ' * 30}</p></li>" for _ in range(20)) + "</ul><table>" + "".join(f"<tr><td>{'cell ' * 50}</td></tr>" for _ in range(20)) + "</table></body>"
    cuts = [own for _, own, _ in splitting.pieces(page)][1:]
    assert cuts and all(page[c:].startswith(("<li>", "<tr>", "<table>", "</ul>", "</table>")) for c in cuts), [page[c : c + 12] for c in cuts]


def test_splitting_edges():
    assert splitting.pieces(None) == [] == splitting.pieces("")
    assert splitting.pieces("x" * 2000) == [(0, 0, 2000)] and len(splitting.pieces("x" * 2001)) == 2
    assert len(splitting.pieces("x" * 1_000_000)) == 527
    with pytest.raises(ValueError):
        splitting.pieces("x", 100, 100)


# ---- packing -------------------------------------------------------------------------------------


def best_fit(histogram, capacity):
    bins = []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            fit = [i for i, r in enumerate(bins) if r >= size]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= size
            else:
                bins.append(capacity - size)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.integers(4, 40), st.data())
def test_plan_is_best_fit_decreasing(capacity, data):
    h = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(1, 9), max_size=10))
    steps, n = packing.plan(h, capacity)
    fill = Counter()
    for size, count in h.items():
        for i in range(count):
            first, container, each = [s for s in steps[size] if s[0] <= i][-1]
            fill[container + (i - first) // each] += size
    assert sorted(capacity - fill[b] for b in range(n)) == best_fit(h, capacity)


def test_packed_documents(spark):
    r = random.Random(2)
    rows = [(i, " word" * r.randint(0, 90) if i % 7 else None, "clash") for i in range(400)] + [(1000, " word" * 500, ""), (1001, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, container string")
    out = packing.packed(df, 100).collect()
    fill = Counter()
    by = {}
    for x in out:
        fill[x["container"]] += x["n_tokens"]
        by.setdefault(x["doc_id"], []).append((x["token_start"], x["n_tokens"]))
    assert set(by) == {x[0] for x in rows} and max(fill.values()) <= 100
    assert sorted(by[1000]) == [(0, 100), (100, 100), (200, 100), (300, 100), (400, 100)] and by[1001] == [(0, 0)] == by[7]
    assert all(len(v) == 1 for k, v in by.items() if k != 1000)
    sizes = Counter(n for v in by.values() for _, n in v if n)
    assert len([b for b in fill if fill[b]]) == len(best_fit(sizes, 100))
    assert packing.packed(df.where("false"), 100).collect() == []


@pytest.mark.parametrize("text", ["1234567890" * 12_000, "x" * 150_000, "word, and  two\n\n " * 9_000, "don't " * 30_000 + "   end", "é漢 " * 60_000, "a <|endoftext|> b " * 8_000])
def test_tokens_of_long_texts_are_those_of_the_whole(text):
    """Long texts are tokenised in parts that end where the tokenizer splits anyway."""
    import tiktoken

    with open(packing.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("t", pat_str=packing.SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    assert packing.counter(packing.VOCABULARY)(text) == len(whole)


def test_tokens_of_very_long_runs():
    count = packing.counter(packing.VOCABULARY)
    assert count("a b c <|endoftext|>") > 4 and count(" " * 1_000_000) > 0 and count("\n" * 300_000 + "x") > 1


# ---- leaks ---------------------------------------------------------------------------------------


def brute_leaks(docs, items, k):
    def grams(t):
        w = [x.lower() for x in leaks.WORD.findall(t or "")]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    return {(d, i) for d, t in docs for i, q in items if grams(t) & grams(q)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab .\nÉé_", max_size=60), max_size=6), st.lists(st.text("ab .Éé", max_size=30), max_size=4))
def test_hits_equal_brute_force(docs, items):
    for k in (1, 2, 3, 4):
        a = leaks.Automaton(list(enumerate(items)), k)
        assert {(d, i) for d, t in enumerate(docs) for i in a.hits(t)} == brute_leaks(list(enumerate(docs)), list(enumerate(items)), k)


@settings(max_examples=150, deadline=None)
@given(st.text("ab ", max_size=60), st.text("ab ", max_size=40))
def test_passages_are_counted_and_placed(doc, item):
    """As many windows as brute force finds, and the stretch from the first one's start to the last one's end."""
    w, q = leaks.WORD.findall(doc), leaks.WORD.findall(item)
    at = [i for i in range(len(w) - 3) if any(w[i : i + 4] == q[j : j + 4] for j in range(len(q) - 3))]
    got = leaks.Automaton([(7, item)], 4).hits(doc)
    spans = [m.span() for m in leaks.WORD.finditer(doc)]
    assert got == ({7: [len(at), spans[at[0]][0], spans[at[-1] + 3][1]]} if at else {})


def test_automaton_of_many_items_is_small():
    """Two nodes a word at most, whatever the windows overlap."""
    r = random.Random(3)
    items = [(i, " ".join(f"v{r.randrange(3000)}" for _ in range(200))) for i in range(200)]
    a = leaks.Automaton(items, 10)
    assert a.nodes <= 2 * 200 * 200 + 1 and a.hits("so " + items[17][1][30:400] + " it goes").keys() == {17}
    many = leaks.Automaton([(1, "a " * 30)], 10)
    begun = time.perf_counter()
    assert many.hits("a " * 200_000)[1][0] == 200_000 - 9 and time.perf_counter() - begun < 20


def test_leaked_with_offsets_and_groups(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"Intro, {words.upper().replace(' ', ' -- ')}! End"), (2, None), (3, ""), (4, "w1 w2 w3"), (5, " ".join(f"w{i}" for i in range(3, 13)))], "doc_id bigint, text string").selectExpr("*", "'x' AS item_id")
    items = spark.createDataFrame([(10, words), (11, words), (12, "too short"), (13, None)], "item_id bigint, text string")
    for most in (10**6, 30):
        got = {(r["doc_id"], r["item_id"]): r for r in leaks.leaked(docs, items, 10, most).collect()}
        assert set(got) == {(1, 10), (1, 11), (5, 10), (5, 11)}
        assert got[1, 10]["passages"] == 21 and docs.first()["text"][got[1, 10]["start"] : got[1, 10]["stop"]].startswith("W0 --") and got[5, 11]["passages"] == 1
    assert leaks.leaked(docs, items.where("false")).collect() == []


# ---- defects -------------------------------------------------------------------------------------

ENDS = defects.Ends({"around": 50, "again": 50, "check": 60, "first": 60, "keep": 9}, {"again": 49, "first": 58})
PROMPT = "How do I restart the worker that reads the index when the disk is slow and the cache is cold?"


@pytest.mark.parametrize("answer,want", [
    (None, "empty"), (" \t\n", "empty"), ("...", "empty"), ("(no content)", "empty"), ("N/A", "empty"), ("​", "empty"), ("No.", None), ("Done.", None), ("Line 42.", None),
    (PROMPT, "copied"), ("> " + PROMPT.lower() + "\n", "copied"), (PROMPT.replace("the worker ", ""), "copied"), ("> " + PROMPT + "\n\nStop it first, then start it again with the new flag, and wait for the log to say so.", None),
    ("I’m sorry, but I can’t help with that request.", "refusal"), ("No, I will not write that for you. Let me know if there is anything else.", "refusal"), ("Diese Aufgabe muss ich ablehnen.", "refusal"), ("Lo siento, pero no puedo ayudarte con esa petición.", "refusal"),
    ("Malheureusement, il m’est impossible de vous aider sur ce point.", "refusal"), ("Sorry for the delay, the first run took longer than planned. The worker restarts when the cache is warm.", None),
    ("I cannot reproduce the failure on a clean checkout, but the cause is visible.", None), ("I can’t help noticing that the default is wrong, so I changed it.", None),
    ("Der Dienst startet neu, wenn der Speicher warm ist, und dann liest er den Index noch einmal.", "other_language"), ("Ключ не найден, повторите позже, пожалуйста, или обратитесь к администратору.", "other_language"),
    ("The worker restarts when the cache is war", "truncated"), ("The worker restarts, and then,", "truncated"), ("Run this:\n```sh\nrestart --now\n", "truncated"), ("Run this:\n```sh\nrestart --now\n```", None), ("See `restart.s", "truncated"),
    ("Steps:\n- check `a.sh` first\n- run it again", None), ("Steps:\n- check `a.sh` first\n- run it around", "truncated"), ("Steps:\n- check `a.sh` first\n- chec", "truncated"), ("The worker (and its cache", "truncated"), ("It restarts…[truncated]", "truncated"),
])
def test_verdicts(answer, want):
    assert defects.verdict(PROMPT, answer, ENDS) == want


@pytest.mark.parametrize("answer,want", [
    ("I'm sorry, but I can't help with that. " * 25, "refusal"), ("I'm sorry, but I can't help with `rm -rf`.", "refusal"), ("I can't help with that. " * 25 + "Run `make` first.", None), ("I can't run it here, but this does it:\n```sh\nmake\n```", None),
    ("<ul><li>one</li><li>two</li>", "truncated"), ("<ul><li>one</li><li>two</li></ul>", None), ('He said "run it again.', "truncated"), ('He said "run it again."', None), ("First (see below.\n\nThe second paragraph is whole.", "truncated"),
    ("I like it :) and the 5\" pipe.", None), ("Use a) the first and b) the second.", None), ("The range [0, 1) is fine.", None), ("See [the page](http://x.y/z", "truncated"), ("| a | b |\n|---|---|\n| 1 | 2", "truncated"), ("| a | b |\n|---|---|\n| 1 | 2 |", None),
    ("Use `(` and ``a ` b`` here.", None), ("Before ```py\nx = (1\n``` and after.", None), ("Steps:\n1.", "truncated"), ("The <b>first</b> and <i>last", "truncated"), ("Compare a < b and c > d.", None), ("Write a <div> element.", None), ('<a href="x.html', "truncated"),
    ("They said „ja“ and «non» and »gut« at once.", None), ("They said „ja and left.", "truncated"), ("Il servizio si riavvia quando la memoria è pronta e poi legge ancora il suo indice, che non è più vuoto.", "other_language"),
    ("O serviço reinicia quando a memória está pronta e depois ele também lê o índice mais uma vez, porque não está vazio.", "other_language"), ("한국어로 답하면 이렇게 되고 색인은 다시 만들어집니다.", "other_language"),
])
def test_parser_grammar_and_languages(answer, want):
    assert defects.verdict(PROMPT, answer, ENDS) == want


def test_short_copies_and_long_repetitions():
    assert defects.verdict("Run it", "run it!", ENDS) == "copied" and defects.verdict("Run it", "Ran it.", ENDS) is None
    many = "again " * 10_000
    begun = time.perf_counter()
    assert defects.tiles(many.split(), many.split()) == 10_000 and defects.is_copy(many, many)
    r = random.Random(1)
    a, b = ([r.choice("ab") for _ in range(5000)] for _ in range(2))
    assert defects.tiles(a, b) > 4000 and time.perf_counter() - begun < 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=20), st.lists(st.sampled_from("abc"), max_size=20))
def test_tiles_leave_no_common_run(a, b):
    """Words covered never fall below what the longest run gives, and equal sequences are covered whole."""
    assert defects.tiles(a, a, 1) == len(a) and defects.tiles(a, b, 1) == sum((Counter(a) & Counter(b)).values())


def test_a_requested_language_is_no_defect():
    german = "Der Dienst startet neu, wenn der Speicher warm ist, und dann liest er den Index noch einmal."
    assert defects.verdict(PROMPT + " Please answer in German.", german, ENDS) is None and defects.verdict(None, german, ENDS) is None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_tiles_never_overlap_and_find_the_longest(a, b):
    n = defects.tiles(a, b, 2)
    longest = max((k for k in range(2, len(a) + 1) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k]), default=0)
    assert longest <= n <= min(len(a), len(b))


def test_defective_rows(spark):
    df = spark.createDataFrame([(1, PROMPT, None, 1), (2, PROMPT, "Restart it.", 2), (3, None, "x" * 100_000 + ",", 3), (4, PROMPT, None, 1)], "id bigint, user_message string, assistant_message string, defect int")
    assert {tuple(r) for r in defects.defective(df).collect()} == {(1, "empty"), (3, "truncated"), (4, "empty")}
    assert defects.defective(df.where("false")).collect() == []


# ---- encodings -----------------------------------------------------------------------------------

CLEAN = {
    "fr": "L’étape réécrit déjà la tête à côté du générateur où l’échange périmé coûte. Ça va, même après l’arrêt.",
    "de": "Der Prüfaufbau verzögert für später die größere Fassung und öffnet während der Prüfung zusätzliche Bereiche.",
    "es": "La sesión última está vacía y la revisión también; el índice común según la migración así quedó.",
    "en": "It’s a naïve façade — “don’t touch it” … Zoë’s café budget: 40 € ± 3 %.",
}


@pytest.fixture(scope="module")
def judge():
    return encoding.Judge({k: " " + " ".join(encoding.WORD.findall(t)) + " " for k, t in CLEAN.items()})


@pytest.mark.parametrize("lang", CLEAN)
@pytest.mark.parametrize("wrong,right,times", [("cp1252", "utf-8", 1), ("cp1252", "utf-8", 2), ("latin-1", "utf-8", 1), ("mac_roman", "utf-8", 1), ("cp437", "utf-8", 1), ("koi8_r", "utf-8", 1), ("mac_roman", "cp1252", 1), ("cp437", "cp1252", 1)])
def test_round_trip(judge, lang, wrong, right, times):
    text = CLEAN[lang].replace("…", ".")
    if right != "utf-8":
        text = "".join(c for c in text if c.encode(right, "ignore"))
    bad = text
    for _ in range(times):
        raw = bad.encode(right)
        bad = "".join(bytes([b]).decode(wrong) if wrong != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)
    got, used = judge.restore(bad)
    assert got == text and used
    assert judge.restore(text) == (text, [])


def test_correct_texts_stay(judge):
    for t in ("ATENÇÃO: A VERSÃO É ANTIGA.", "Ключ не найден, повторите позже.", "日本語の行もある。", "검색 색인이 다시 만들어졌다.", "Þórr, Łódka, Ça va, Åse.", "Café with two points", "┌──┐│é│└──┘"):
        assert judge.restore(t) == (t, []), t


def test_many_garblings_in_one_text(judge):
    """Six ways in one text, five times over in another: all are undone, and no word is made worse."""
    ways = [("cp1252", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp1251", "utf-8"), ("cp850", "cp1252"), ("koi8_r", "utf-8")]
    text = CLEAN["fr"].replace("’", "'") + " " + CLEAN["de"]
    bad = " ".join(text.encode(right).decode(wrong, "replace") for wrong, right in ways)
    got, used = judge.restore(bad)
    assert got == " ".join([text] * 6) and len(used) >= 6
    deep = text
    for _ in range(5):
        deep = deep.encode().decode("latin-1")
    assert judge.restore(deep)[0] == text


def test_encodings_of_several_bytes():
    """UTF-8 read as GB18030, and Japanese read as a one-byte encoding, with a corpus that knows the words."""
    words = {"zh": " 索引重新建立 会话已经关闭 档案读取完成 ", "ja": " 索引を作り直しました セッションを閉じました ", "fr": " été déjà générateur même après périmé "}
    judge = encoding.Judge(words)
    assert judge.restore("note: " + "会话已经关闭".encode().decode("gb18030"))[0] == "note: 会话已经关闭"
    assert judge.restore(" ".join("été déjà générateur même après".encode().decode("gb18030").split()))[0] == "été déjà générateur même après"
    assert judge.restore("索引を作り直しました".encode("shift_jis").decode("latin-1"))[0] == "索引を作り直しました"
    assert judge.restore("会话已经关闭".encode("gb18030").decode("latin-1"))[0] == "会话已经关闭"
    for t in ("索引重新建立了，请稍后再试。", "セッションは後で開き直してください。", "Þórr, Łódka, Ça va, Åse, Zoë, naïve.", "联通 移动", "색인을 다시 만들었다."):
        assert judge.restore(t) == (t, []), t


def test_garbled_rows(spark):
    clean = [(i, CLEAN[k], k, "c") for i, k in enumerate(list(CLEAN) * 5)]
    bad = [(100, CLEAN["fr"].encode().decode("latin-1"), "fr", None), (101, "lost � sign", None, None), (102, None, None, None), (103, "", "en", None), (104, "plain ascii", None, None), (105, "x " * 50_000 + "cafÃ© dÃ©jÃ  vu", None, None)]
    df = spark.createDataFrame(clean + bad, "doc_id bigint, text string, lang string, chain string")
    got = {r["doc_id"]: r for r in encoding.garbled(df).collect()}
    assert set(got) == {100, 101, 105} and got[100]["restored"] == CLEAN["fr"] and got[101]["lost"] and got[105]["restored"].endswith("café déjà  vu")
    assert encoding.garbled(df.where("false")).collect() == []
