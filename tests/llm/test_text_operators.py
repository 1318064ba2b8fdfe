"""op4, op8 and op9: held-out accuracy, edge rows and exact inverses."""

import math
import random
import zlib

import numpy as np
import pytest
import regex

from ledgerloom.llm import language_id, pii, quality

DATA = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, " \n"), (4, "123 456 !!"), (5, "x" * 200_000), (6, "the of and"), (6, "the of and"), (None, "the of and")]


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = language_id.op8_language_id(spark, DATA).toPandas()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(out) == docs.count()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert (held.lang_pred == held.doc_id.map(lang)).mean() > 0.98
    assert held.score.between(0, 1).all()


def test_language_edges(spark):
    train = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("the of and to the of", "en"), ("der die und der das", "de"), (None, "en"), ("x", None)] * 5)], "doc_id bigint, text string, lang string")
    model = language_id.fit(train)
    docs = spark.createDataFrame([(d, t, 7) for d, t in EDGES], "doc_id bigint, text string, score int")
    rows = {(r.doc_id, i): r for i, r in enumerate(language_id.predict(docs, model).collect())}
    assert len(rows) == len(EDGES)
    told = [r.lang_pred for r in rows.values()]
    assert told[:4] == ["und"] * 4 and told[5:] == ["en"] * 3
    assert language_id.predict(docs.limit(0), model).count() == 0
    none = language_id.fit(train.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_unseen_words_fall_back(spark):
    train = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("blething thertion anding", "en"), ("schkeit unglich einung", "de")] * 20)], "doc_id bigint, text string, lang string")
    model = language_id.fit(train)
    got = language_id.predict(spark.createDataFrame([(1, "thingble"), (2, "lichkeit")], "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en", "de"]


def test_texts_without_a_letter(spark):
    """Numerals and marks that regular expressions count as word characters are no letters."""
    train = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("the of and to the of", "en"), ("der die und der das", "de")] * 5)], "doc_id bigint, text string, lang string")
    texts = ["½ ¾", "² ³", "①②", "Ⅷ", "_ __ 12", "の", "ª", "the½"]
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), language_id.fit(train)).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in got] == [not regex.search(r"\p{L}", t) for t in texts]


def plain_language(text, model):
    """Words one by one: known words, else the longest known n-grams."""
    langs, known, scores = model["langs"], model["known"], model["scores"].astype(float)
    total, words = np.zeros(len(langs)), regex.findall(r"\p{L}+", (text or "").lower())
    for w in words:
        if "w" + w in known:
            total += scores[known["w" + w]]
            continue
        for k in (5, 4, 3, 2, 1):
            marked = f"<{w}>" if k > 1 else w
            found = [scores[known["g" + marked[i : i + k]]] for i in range(len(marked) - k + 1) if "g" + marked[i : i + k] in known]
            if found:
                total += np.mean(found, axis=0)
                break
    if not words:
        return "und", 0.0
    return langs[int(np.argmax(total))], 1 / np.exp(total - total.max()).sum()


def test_language_equals_a_plain_backoff(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where("doc_id % 3 = 0"), rows_per_lang=60, max_words=300, max_grams=2000)
    got = language_id.predict(docs, model).collect()
    assert len(got) > 900
    for r in got[:400]:
        lang, score = plain_language(r.text, model)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3, r.doc_id


def plain_quality(text, model):
    """The score of one text, feature by feature, in whole numbers."""
    mask, power = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x &= mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    words, found = regex.findall(r"[^\x20\x09-\x0D]+", text or ""), []
    for k, w in enumerate(words):
        chars = [mix(c + 1) for c in (2, *[int.from_bytes(ch.encode(), "little") for ch in w], 3)]
        found.append(mix(sum(c * mix(i + power) for i, c in enumerate(chars))) % quality.BUCKETS)
        for n in quality.GRAMS:
            for i in range(len(chars) - n + 1):
                key = 0
                for c in chars[i : i + n]:
                    key = (key + c) * power & mask
                found.append(mix(key + n) % quality.BUCKETS)
        if k and w == words[k - 1]:
            found += [quality.REPEATED] * 4
    logit = model["bias"] + (sum(model["effect"][b] for b in found) / len(found) if found else 0)
    return 1 / (1 + math.exp(-logit))


def test_quality_equals_plain_features(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"), most_rows=200)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + ["é é été", "日本 a a a", "", None, "x" * 300]
    got = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    for r in got:
        assert abs(r.score - plain_quality(r.text, model)) < 1e-9, r.doc_id


def test_quality_accuracy(spark):
    out = quality.op4_quality(spark, DATA).toPandas()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    held = out[out.held_out & out.doc_id.isin(list(label))]
    assert (held.predicted == held.doc_id.map(label)).mean() > 0.9
    assert ((out.score >= 0.7) == (out.predicted == 1)).all() and out.score.between(0, 1).all()


def test_quality_edges(spark):
    model = quality.train(["good words here", "bad*** bad*** bad***"] * 20, [1, 0] * 20)
    docs = spark.createDataFrame([(d, t, "s") for d, t in EDGES], "doc_id bigint, text string, score string")
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].score == rows[1].score == rows[2].score and rows[5].score == rows[6].score == rows[7].score
    assert quality.score(docs.limit(0), model).count() == 0
    scores = [r.score for r in quality.score(spark.createDataFrame([(1, "good words"), (2, "bad*** bad***")], "doc_id int, text string"), model).collect()]
    assert scores[0] > 0.7 > scores[1]
    for labels in ([], [1, 1]):
        assert 0 <= quality.score(docs, quality.train(["a"] * len(labels), labels)).first().score <= 1
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.fit(docs, none)["effect"].sum() == 0


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    got = [pii.permuted(i, size, b"k", "t") for i in range(size)]
    assert sorted(got) == list(range(size))
    assert [pii.permuted(x, size, b"k", "t", back=True) for x in got] == list(range(size))


def test_pii_keeps_formats_and_comes_back():
    rng = random.Random(3)
    for _ in range(200):
        digits = "".join(rng.choice("0123456789") for _ in range(15))
        card = digits + pii.luhn_digit(digits)
        text = f"a {card} b {rng.randrange(256)}.{rng.randrange(256)}.0.1 c +1 ({rng.randrange(1000):03d}) 555-{rng.randrange(10000):04d} d {rng.randrange(1900, 2099)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)} e öä.{rng.randrange(100)}@mail.example.com"
        new, counts = pii.pseudonymised(text, b"key")
        assert pii.pseudonymised(new, b"key", back=True)[0] == text
        assert set(counts) == {"card", "ip", "phone", "date", "email"} and card not in new
        again, more = pii.pseudonymised(new, b"other")
        assert set(more) == set(counts) and len(new.split()) == len(text.split())


@pytest.mark.parametrize("text", ["иван.петров@mail.ru", "ŁukaszŻ@x.pl", "ελένη@x.gr", "田中@x.jp", "a" * 300 + "@x.com", "378282 246310005".replace("378282 246310005", "3782 822463 10005"), "+491711234567", "٣٤٥@x.eg"])
def test_pii_of_all_alphabets(text):
    new, counts = pii.pseudonymised(f"to {text} now", b"key")
    assert sum(counts.values()) == 1 and pii.pseudonymised(new, b"key", back=True)[0] == f"to {text} now"
    name, old = new[3:-4].rpartition("@")[0] or new[3:-4], text.rpartition("@")[0] or text
    assert len(name) == len(old) and all(a.isalpha() == b.isalpha() and a.isdigit() == b.isdigit() and a.isupper() == b.isupper() for a, b in zip(name, old, strict=True))
    assert sum(a != b for a, b in zip(name, old, strict=True)) >= len(old) / 3


def test_pii_counts_only_changes():
    assert pii.pseudonymised("__@x.com", b"k") == ("__@x.com", {})
    assert pii.pseudonymised("w" * 300_000, b"k") == ("w" * 300_000, {})  # in linear time


def test_pii_leaves_other_numbers():
    text = "1234567890123456 999.1.1.1 2024-13-45 000-12-3456 666-12-3456 7.7.7 v1.2 0000000000000000 a@b"
    assert pii.pseudonymised(text, b"k") == (text, {})


def test_equal_values_stay_linked(spark):
    rows = [(1, "mail x.1@mail.example.com", "q"), (2, "x.1@mail.example.com again", "q"), (2, "x.1@mail.example.com again", "q"), (3, None, "q"), (None, "", "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kinds string")
    got = pii.pseudonymise(docs, b"k").collect()
    mails = {w for r in got for w in (r.text or "").split() if "@" in w}
    assert len(mails) == 1 and mails != {"x.1@mail.example.com"}
    assert [(r.doc_id, r.n_values, r.kinds) for r in got] == [(1, 1, "email"), (2, 1, "email"), (2, 1, "email"), (3, 0, ""), (None, 0, "")]
    assert got[3].text is None and got[4].text == ""
    assert pii.pseudonymise(docs.limit(0), b"k").count() == 0


def test_query_equals_plain_calls(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    spark.conf.set(pii.KEY_CONF, "some key")
    out = pii.op9_pii(spark, DATA).collect()
    spark.conf.unset(pii.KEY_CONF)
    assert len(out) == len(docs)
    for r in out:
        new, counts = pii.pseudonymised(docs[r.doc_id], b"some key")
        assert (r.text, r.n_values, r.kinds) == (new, sum(counts.values()), ",".join(sorted(counts)))


@pytest.mark.parametrize("text,kind", [("+49 30 1234567", "phone"), ("+44 20 7946 0958", "phone"), ("030 1234567", "phone"), ("+1 (555) 010-9999", "phone"), ("12-31-1999", "date"), ("2001:db8::8a2e:370:7334", "ip6"), ("FE80::1", "ip6"), ("2001:0DB8:0000:0000:0000:FF00:0042:8329", "ip6"), ('"sk_Live-9aZ81bQ77xPqR2tt"', "token"), ("a@b.de", "email"), ("q@ivanov-peter.de", "email")])
def test_pii_more_formats(text, kind):
    """Each is found, changes, keeps its form and comes back, under many keys."""
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in s)
    for k in range(60):
        new, counts = pii.pseudonymised(f"see {text}, now", f"key{k}".encode())
        assert counts == {kind: 1} and new != f"see {text}, now" and len(new) == len(text) + 9
        assert kind == "ip6" or shape(new) == shape(f"see {text}, now")
        assert pii.pseudonymised(new, f"key{k}".encode(), back=True) == (f"see {text}, now", counts)
    if kind == "phone" and text[0] == "+":
        assert new[4:].startswith(text.split()[0])


def test_pii_domains_by_option():
    new, _ = pii.pseudonymised("m@ivanov-peter.de", b"k", domains=True)
    name, _, host = new.partition("@")
    assert host.endswith(".de") and host != "ivanov-peter.de" and pii.pseudonymised(new, b"k", back=True, domains=True)[0] == "m@ivanov-peter.de"
    assert pii.pseudonymised("m@ivanov-peter.de", b"k")[0].endswith("@ivanov-peter.de")


def test_pii_leaves_versions_times_and_names():
    text = "version 3.14.15.92 at 12:34:56 and std::vector, a::b, 0::, 31-12-1999, 99:99, 'AllLettersNoDigitsHereAtAll', 0123 45, +1 2 3, 1:2:3:4:5:6:7:8"
    assert pii.pseudonymised(text, b"k") == (text, {})


@pytest.mark.parametrize("size", [2, 3, 10, 26, 1000])
def test_pii_no_value_stands_for_itself(size):
    assert all(pii.permuted(i, size, f"k{k}".encode(), "t") != i for k in range(20) for i in range(min(size, 60)))
