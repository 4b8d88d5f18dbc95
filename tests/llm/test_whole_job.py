"""Cases in which an operator once did less than its whole job."""

import re

import numpy as np

from pluvio.llm import chat, licenses, secrets, url_filter
from pluvio.llm.quality_model import quality


def test_quality_of_held_out_toxic_documents(spark):
    """The insults of the labelled toxic documents are all English; toxic documents in other languages hold none."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    digits = "".join(map(str, np.random.default_rng(3).integers(0, 10, 3000)))
    docs = docs.where("doc_id >= 0").unionByName(spark.createDataFrame([(-1, digits, "en"), (-2, "9" * 3000, "de")], docs.schema))
    out = quality(docs, labels.where("doc_id % 3 > 0")).cache()
    rows = out.join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    share = lambda keep: float(np.mean([r.kept for r in rows if keep(r)]))
    assert share(lambda r: r.quality == 1 and r.toxic == 0) >= 0.97
    assert share(lambda r: r.toxic == 1 and r.lang == "en") <= 0.15 and share(lambda r: r.quality == 0) <= 0.05
    assert [r.kept for r in out.where("doc_id < 0").collect()] == [False, False]


def test_keys_after_names_and_paths():
    """Keys are covered whole after NAME=, path/ and id-; an allowed word, name or id before a key does not allow the key."""
    rng = np.random.default_rng(5)
    allowed = re.compile(b"|".join(b"(?:%s)" % p for p in secrets.ALLOWED), re.S)
    classes = {"hex": "0123456789ABCDEF", "alnum": "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))}
    classes["base64"] = classes["alnum"] + "+/"
    for name, signs in classes.items():
        for before in ("", "CLIENT_KEY=", "keys/", "id-", "example/", "a-placeholder=", "x=1/", "Deploy_Keys-2024_"):
            missed = 0
            for _ in range(100):
                key = "".join(rng.choice(list(signs), 64))
                spans = secrets.find_spans(f"see {before}{key} there", allowed)
                inside = {i for s, _, e in spans for i in range(s, e)}
                missed += len(set(range(4 + len(before), 4 + len(before) + 64)) - inside)
            assert missed <= (0 if name == "hex" else 64), (name, before)
    for text in ("id-550e8400-e29b-41d4-a716-446655440000", "path/to/550e8400-e29b-41d4-a716-446655440000", "KEY=placeholder_of_the_secret_key", "a/long/path/of-words/2024-11-30/ends_here"):
        assert secrets.find_spans(text, allowed) == []


def test_records_with_a_field_of_another_mapping(spark):
    records = ['{"instruction":"q","input":"","output":"a","text":"whole"}', '{"prompt":"q","prompt_id":"7","messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}',
               '{"system":"s","conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"instruction":"q","context":"c","response":"a","category":"x"}',
               '{"id":1,"system_prompt":"s","question":"q","response":"a"}', '{"prompt":"q","response":"a","text":"whole","role":"x"}']
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string").selectExpr("conv_id", "0L as turn", "record")
    got = {}
    for r in sorted(chat.format_chats(df).collect(), key=lambda r: (r.conv_id, r.nth)):
        got.setdefault(r.conv_id, []).append(r.segment)
    system, q, a = (chat.render(*x)[0] for x in (("system", "s"), ("user", "q"), ("assistant", "a")))
    assert got == {0: [chat.render("user", "q\n\n")[0], a], 1: [q, a], 2: [system, q, a], 3: [chat.render("user", "q\n\nc")[0], a], 4: [system, q, a], 5: [q, a]}


def test_hosts_without_outcomes(spark):
    """A host without labelled pages is judged by its registered domain, or by its suffix."""
    hosts = [f"h{i}.{d}" for d in ("spam.com", "fine.com", "a.bad", "b.bad", "c.bad", "d.bad") for i in range(20)] + [f"{'no' if i % 2 else 'ok'}{i}.mixed.org" for i in range(20)]
    pages = [(20 * n + i, f"http://{host}/{i}") for n, host in enumerate(hosts) for i in range(20)]
    outcome = [(i, 0 if "spam.com" in url or ".bad/" in url or "//no" in url else 1, 0) for i, url in pages]
    new = {-1: "new.spam.com", -2: "new.fine.com", -3: "www.new.bad", -4: "new.mixed.org", -5: "other.com", -6: "x.unseen"}
    df = spark.createDataFrame(pages + [(i, f"http://{h}/") for i, h in new.items()], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df, spark.createDataFrame(outcome, "doc_id long, quality int, toxic int"), []).where("page_id < 0").collect()}
    assert got == {-1: "block", -2: "allow", -3: "block", -4: "allow", -5: "allow", -6: "allow"}


def test_licenses_are_told_apart():
    known = [licenses.Template(name, text) for name, text in licenses.TEMPLATES.items()]
    names = lambda text: [f[0] for f in licenses.scan(f"Some words stand before. {text} And some after it.", known)]
    for name, text in licenses.TEMPLATES.items():
        assert names(text) == [name], name
    for text, want in {
            "Licensed under CC BY-SA 4.0": ["cc-by-sa-line"], "Licensed under CC BY 4.0": ["cc-by-line"], "Released under the Zlib License.": [],
            "This work is licensed under the GNU General Public License, version 2": ["gpl-2.0-line"], "Released under the BSD License": ["bsd-line"],
            "This work is licensed under the GNU Lesser General Public License, version 3": ["lgpl-line"], "Licensed under the Apache License, Version 1.1": [],
            "This work is licensed under the GNU Affero General Public License, version 3.": ["agpl-line"], "Licensed under CC BY-NC 3.0.": [],
            "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy and distribute "
            "verbatim copies of this license document, but changing it is not allowed.": ["gpl-3.0-text"]}.items():
        assert names(text) == want, text


def test_rows_of_signs_end():
    """Ten thousand signs in a row, around and between words, and words that fit the allow-list in no or several ways."""
    import time
    allowed = re.compile(b"|".join(b"(?:%s)" % p for p in secrets.ALLOWED), re.S)
    key = "aB3x9Q7kLmP2sT8v"
    for sign in "-_=+/":
        row = sign * 10_000
        for text in (row, row + key, key + row, row + "aB3x9Q7" + row, ("A" + sign) * 5000 + "a1B2c3", ("Ab" + sign) * 5000 + "!", ("a1" + sign) * 3000, sign * 11 + key, sign * 20 + key + key):
            start = time.perf_counter()
            spans = secrets.find_spans(text, allowed)
            assert time.perf_counter() - start < 0.1, (sign, len(text))
            assert key + key not in text or spans
    assert secrets.find_spans("0" * 3000 + " " + "ab" * 4000, allowed)[0][:2] == (0, 2)
    dump = "\n".join(f"{i:032x}" for i in range(30_000))
    start = time.perf_counter()
    assert len(secrets.find_spans(dump, allowed)) >= 30_000 and time.perf_counter() - start < 5


def test_rows_without_an_id_are_judged_alone(spark):
    """A bad row without doc_id, or with the id of a good one, takes no good row with it."""
    from pluvio.llm.decontaminate import clean_documents
    from pluvio.llm.quality_model import trusted_documents
    words = [f"word{i}" for i in range(40)]
    leak = " ".join(words[:20])
    clean = "nothing of the benchmark stands in this text at all , not even a part of it"
    rows = [(None, leak, "en"), (None, clean, "en"), (None, clean + " more", "en"), (1, leak, "en"), (1, clean, "en"), (2, None, "en"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'t' as tag", "1 as __tag")
    left = clean_documents(docs, spark.createDataFrame([("i", leak)], "item_id string, text string"))
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted((i or 0, t or "") for i, t, _ in rows if t != leak)

    good = ["the quick brown fox jumps over the lazy dog and runs away into the old wood " * 3 + str(i) for i in range(200)]
    trusted = [(i, t, "en") for i, t in enumerate(good)]
    odd = [(None, "", "en"), (None, good[153], "en"), (None, None, "en"), (157, "", "en")]
    docs = spark.createDataFrame(trusted + odd, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    kept = [(r.doc_id, r.text) for r in trusted_documents(docs, labels).collect()]
    assert (153, good[153]) in kept and (None, good[153]) in kept and (157, good[157]) in kept  # the bad rows beside them go alone
    assert not {(None, ""), (None, None), (157, "")} & set(kept)


def test_kneser_ney_against_a_plain_model(spark):
    """The same probabilities from dictionaries: continuation counts, three discounts an order, interpolation down to equal chances."""
    from collections import Counter

    from pluvio.llm.quality_model import kneser_ney
    rng = np.random.default_rng(12)
    text = rng.choice(6, 900, p=[0.4, 0.25, 0.15, 0.1, 0.07, 0.03]).tolist()
    whole = Counter(tuple(text[i:i + 4]) for i in range(len(text) - 3))
    tables = {4: whole}
    for order in (3, 2, 1):
        tables[order] = Counter(g[1:] for g in tables[order + 1])
    code = lambda gram: int(sum(c * 64 ** i for i, c in enumerate(reversed(gram))))
    want, below = [], {(): 1 / 64}
    for order in range(1, 5):
        n = Counter(tables[order].values())
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 0.9]
            take = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]
        else:
            take = [0.5, 0.75, 0.9]
        total, lost = Counter(), Counter()
        for gram, c in tables[order].items():
            total[gram[:-1]] += c
            lost[gram[:-1]] += take[min(c, 3) - 1]
        now = {g: (c - take[min(c, 3) - 1]) / total[g[:-1]] + lost[g[:-1]] / total[g[:-1]] * below[g[1:] if order > 1 else ()] for g, c in tables[order].items()}
        want.append({code(g): p for g, p in now.items()})
        below = now
    counts = spark.createDataFrame([(code(g), c) for g, c in whole.items()], "gram long, n long")
    for (seen, _), plain in zip(kneser_ney(counts), want):
        got = {r.gram: r.p for r in seen.collect()}
        assert got.keys() == plain.keys() and all(abs(got[g] - p) < 1e-12 for g, p in plain.items())


def plain_costs(texts):
    """Costs of four UTF-16 units by dictionaries, digits read as 0, from the trusted `texts`; unseen ones by their back-off."""
    from collections import Counter
    grams = lambda text: [tuple(u[i:i + 4]) for u in [[10] * 3 + np.frombuffer(re.sub(r"\d", "0", text).encode("utf-16-le"), np.uint16).tolist()] for i in range(len(u) - 3)]
    tables = {4: Counter(g for text in texts for g in grams(text))}
    for order in (3, 2, 1):
        tables[order] = Counter(g[1:] for g in tables[order + 1])
    total, lost, take = Counter(), Counter(), {}
    for order, table in tables.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
        raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 0.9] if y else None
        take[order] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)] if raw else [0.5, 0.75, 0.9]
        for gram, c in table.items():
            total[gram[:-1], order] += c
            lost[gram[:-1], order] += take[order][min(c, 3) - 1]

    def p(gram):
        order = len(gram)
        if not order:
            return 1 / 65536
        if not total[gram[:-1], order]:
            return p(gram[1:])
        c = tables[order][gram]
        return (c - take[order][min(c, 3) - 1] if c else 0) / total[gram[:-1], order] + lost[gram[:-1], order] / total[gram[:-1], order] * p(gram[1:])
    return lambda text: sum(round(-1000 * np.log(max(p(g), 1e-25))) for g in grams(text))


SCRIPTS = ["съешь же ещё этих мягких французских булок да выпей чаю", "ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "いろはにほへと 散りぬるを 我が世誰ぞ 常ならむ",
           "the quick brown fox jumps over 12 lazy dogs", "نص حكيم له سر قاطع وذو شأن عظيم", "\U0001f600\U0001f601 é́ \U00020000"]


def scripts(n):
    rng = np.random.default_rng(21)
    return [" ".join(rng.permutation(SCRIPTS[i % 6].split()).tolist() * (1 + i % 3)) for i in range(n)]


def test_sums_of_count_joins_against_a_plain_model(spark):
    """The sums of each document by the model of all trusted texts and by that of the other fold, in every script, over several blocks and rows without id."""
    from pyspark.sql import functions as F

    from pluvio.llm import quality_model as Q
    texts = scripts(90) + ["", None, "unseen signs: กข ა ٣7"]
    rows = [(i, text, i % 2) for i, text in enumerate(texts)] + [(None, texts[0], 0), (3, texts[4], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fold int").selectExpr("*", "'x' as lang", "doc_id as tag").repartition(3)
    trusted = {i for i in range(90) if i % 5}
    good = [r for r in rows if r[0] in trusted]
    by = [plain_costs([t for _, t, fold in good if fold != i]) for i in (0, 1, 2)]
    want = sorted((-1 if i is None else i, by[2](text or ""), by[fold](text or "") if i in trusted else 0) for i, text, fold in rows)
    scored = Q._scored(docs, spark.createDataFrame([(i,) for i in trusted], "id long"))
    got = sorted(tuple(r) for r in scored.select(F.coalesce("doc_id", F.lit(-1)), "millinats", "unseen").collect())
    assert len(got) == len(want) and [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(a - b) <= 2 for g, w in zip(got, want) for a, b in zip(g, w))  # of sums of rounded costs, which may be halves


def test_joined_costs_are_those_of_the_listed_table(spark):
    from pluvio.llm.quality_model import ORDER, SYMBOLS, cost_table, costs, gram_counts, kneser_ney
    model = kneser_ney(gram_counts(spark.createDataFrame([("the cat sat on the mat. " * 20,), ("a dog ran to the cat and sat. " * 15,)], "text string")))
    seen = [r.gram for r in model[-1][0].collect()]
    wanted = sorted({*seen, *(g % SYMBOLS ** 3 for g in seen), *np.random.default_rng(2).integers(0, SYMBOLS ** ORDER, 3000).tolist()})
    table = cost_table(model)
    got = {r.gram: r.cost for r in costs(model, spark.createDataFrame([(0, g) for g in wanted], "model int, gram long")).collect()}
    assert sorted(got) == wanted and all(abs(got[g] - int(table[g])) <= 1 for g in wanted)


def test_quality_in_every_script(spark):
    """Letters in random order are not kept, whatever the script; once all letters beyond Latin-1 were one symbol."""
    texts = scripts(960)
    rng = np.random.default_rng(22)
    junk = ["".join(rng.permutation(list(SCRIPTS[i] * 4)).tolist()) for i in range(5)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(-1 - i, t, "x") for i, t in enumerate(junk)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(900)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert not any(kept[-1 - i] for i in range(5)) and np.mean([kept[i] for i in range(900, 960)]) >= 0.9


def test_quality_of_characters_beyond_the_first_plane(spark):
    """Each letter follows from the two before it. Any letter may follow any one, which is all that four UTF-16 units see of such a script."""
    rng = np.random.default_rng(23)

    def text(jumps):
        letters = [0, 1]
        for jump, other in zip(rng.random(400) < jumps, rng.integers(0, 9, 400)):
            letters.append(int(other) if jump else (letters[-1] + letters[-2]) % 9)
        return "".join(chr(0x10330 + x) for x in letters)
    rows = [(i, text(0.1), "x") for i in range(220)] + [(-1 - i, text(1), "x") for i in range(5)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(180)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert not any(kept[-1 - i] for i in range(5)) and np.mean([kept[i] for i in range(180, 220)]) >= 0.9


def test_symbols_of_characters_beyond_the_first_plane():
    from pluvio.llm.quality_model import _FAR, _given, _grams, _units
    codes = lambda text, far=_FAR: np.concatenate(list(_grams(text, far=far))).tolist()
    assert codes("a\U0001d7d7\U0001e955b") == codes("a90b") == codes("a\u0663\U000104a1b")  # decimal digits of any plane
    some = "".join(map(chr, [*range(0x3400, 0x9FFF), *range(0x20000, 0x28000)]))
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for text in (some, every):
        far = _given(np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32)))
        seen = [tuple(_units(c, far)) for c in text if not c.isdecimal()]
        assert len(set(seen)) == len(seen) and {len(s) for s in seen} == ({1} if text is some else {1, 2})
        assert _units(text[-9000:], far).tolist() == [u for s in seen[-9000:] for u in s]
