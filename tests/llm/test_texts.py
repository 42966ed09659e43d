"""Language ID, secrets, BPE and PII."""

import hashlib
import random
import re
import string

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from weftline.llm import bpe, language, pii, secrets

ODD = [(1, None), (2, ""), (3, " \n "), (4, "x" * 50_000), (5, "a b " * 20_000), (6, "same"), (6, "same"), (None, "no id"), (7, "𝒳é　z ​")]


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# --- byte-level BPE -----------------------------------------------------------------------------------------------------


def reference():
    tokens = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tokens, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_bpe_equals_the_library_on_random_texts():
    tokens, library = reference()
    codec = bpe.Codec(tokens, bpe.serialise(tokens), P.PATTERN)
    draw = random.Random(3)
    texts = ["".join(draw.choices("ab'sé\n\t  　12½.!日𝒳 ​\x00'llTH", k=draw.randrange(70))) for _ in range(4000)] + [t or "" for _, t in ODD]
    got = codec.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(g).decode() for g in got] == texts


def test_bpe_rows(docs):
    _, library = reference()
    rows = bpe.byte_bpe(docs(ODD), with_ids=True).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = next(t for i, t in ODD if i == r.doc_id) or ""
        assert r.ids == library.encode_ordinary(text) and r.n_tokens == len(r.ids) and r.decoded_sha256 == sha(text)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert bpe.byte_bpe(docs([])).count() == 0


def test_bpe_needs_all_bytes():
    with pytest.raises(ValueError):
        bpe.serialise([b"a"])


# --- secrets ------------------------------------------------------------------------------------------------------------


def brute_secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_base_equals_brute_force(docs):
    draw = random.Random(9)
    parts = ["password", "TOKEN", "api_key", "apikey", "Secret", ":", "=", " ", '"', "'", "AKIA", "abcdef0123456789" * 2, "ABCDEFGHIJKL", "x", "é", "\n", "ſecret=12345678", "toKen=12345678"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(12))) for _ in range(1500)]
    rows = [*enumerate(texts, 100), *ODD]
    got = secrets.scan(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == sorted((str(i), sha(brute_secrets(t))) for i, t in rows)
    assert all(r.spans.count("assign:") == r.n_assign and r.spans.count("access:") == r.n_access and r.spans.count("hex:") == r.n_hex for r in got)


def test_secrets_models_find_random_strings_and_spare_identifiers(docs):
    draw = random.Random(10)
    words = [f"{a}{b}" for a in ("load", "write", "table", "index", "customer", "process") for b in ("Result", "Value", "Manager", "Config")]
    random_ones = [(i, f"see {''.join(draw.choices(string.ascii_letters + string.digits, k=40))} here") for i in range(60)]
    plain = [(i, f"call {'_'.join(draw.choices(words, k=3))} then {''.join(draw.choices(words, k=3))} now") for i in range(100, 160)]
    df = docs([*random_ones, *plain])
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert sum(got[i].n_markov == 1 for i, _ in random_ones) >= 57 and sum(got[i].n_markov > 0 for i, _ in plain) <= 3
    assert {r.text for r in secrets.redacted(df).where("doc_id < 60").collect()} >= {"see [SECRET] here"}
    assert secrets.scan(docs([])).count() == 0 and secrets.redacted(docs(ODD)).columns == docs(ODD).columns


# --- PII ----------------------------------------------------------------------------------------------------------------


def luhn(s):
    return sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(s))) % 10 == 0


def brute_pii(text):
    text, digits = text or "", lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_base_equals_brute_force(docs):
    draw = random.Random(4)
    texts = ["".join(draw.choices("ab.@-_ 0159+()%é𝒳\n", k=draw.randrange(80))) for _ in range(1500)]
    texts += ["a@b.c_x@d.e a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.0255", "4111 1111 1111 1111", "+1 (555) 555-0100 x", "1 " * 4000, "a." * 4000 + "@b" + ".c" * 4000]
    rows = [*enumerate(texts, 100), *ODD]
    got = pii.extract(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == sorted((str(i), sha(brute_pii(t))) for i, t in rows)


def test_pii_contexts_find_unseen_identifiers(docs):
    rows = [(i, f"please reach me at user{i}@mail.test today") for i in range(8)] + [(20, "then reach me at handle99x today"), (21, "the of in handle99y is at word")]
    got = {r.doc_id: r for r in pii.extract(docs(rows)).collect()}
    assert got[20].spans == "context:17:26" and got[20].n_context == 1 and got[21].n_context == 0 and got[3].n_email == 1
    assert pii.extract(docs([])).count() == 0


def test_pii_follows_rare_contexts_in_a_large_corpus(docs):
    """4,000 seeds of other contexts, 1,100 contexts with three seeds each: none is too rare or too many to follow."""
    rows = [(i, f"please reach me at user{i}@mail.test today") for i in range(4000)]
    rows += [(10_000 + 3 * k + i, f"word{chr(97 + k % 26)}{'x' * (k // 26)} holds u{k}n{i}@mail.test today") for k in range(1100) for i in range(3)]
    rows += [(20_000 + k, f"word{chr(97 + k % 26)}{'x' * (k // 26)} holds handle99x today") for k in range(1100)]
    got = {r.doc_id: r.n_context for r in pii.extract(docs(rows)).collect()}
    assert all(got[20_000 + k] == 1 for k in range(1100))


def test_pii_copies_leave_scores_as_they_are(docs):
    rows = [(i, f"the account number user{i}@mail.test is open") for i in range(8)] + [(100 + i, "the account number was lost") for i in range(300)] + [(900, "the account number handle99x is open")]
    got = {r.doc_id: r.n_context for r in pii.extract(docs(rows)).collect()}
    assert got[900] == 1


def test_pii_seeds_are_whole_matches(docs):
    """Spaced phones and cards, and e-mails without a digit, each teach their context."""
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004"]
    rows = [(i, f"please call me on +1 (017) 555-771{i} today") for i in range(4)] + [(10 + i, f"then charge my card {c} today") for i, c in enumerate(cards)]
    rows += [(20 + i, f"or write to ({n}.doe@example.com) now") for i, n in enumerate(["jane", "john", "jim", "joan"])]
    rows += [(30, "call me on handle30x"), (31, "charge my card handle31x"), (32, "or write to handle32x"), (33, "the of in handle33x")]
    got = {r.doc_id: r for r in pii.extract(docs(rows)).collect()}
    assert [got[i].n_context for i in (30, 31, 32, 33)] == [1, 1, 1, 0] and got[0].n_phone == got[10].n_card == got[20].n_email == 1


def test_pii_contexts_are_precise_among_ordinary_numbers(docs):
    """Unseen identifiers outnumber the seeds of their contexts; ordinary numbers and card-like decoys stand among prose, as cards do."""
    draw = random.Random(7)
    made = ["".join(draw.choices("aeiou" "bdfklmnrst", k=draw.randrange(2, 8))) for _ in range(400)]
    prose = lambda n: draw.choices(made, k=n)
    phrases = [("please contact", "today please"), ("write soon to", "or later"), ("my number is", "right now"), ("account holder is", "for details")]
    seed = lambda k, i: (f"user{k}x{i}@mail.test", f"+1 (555) {100 + k}-{1000 + i}", f"10.{k}.{i}.7")[i % 3]
    unseen = lambda k, i: (f"X{k}R-{88000 + 13 * i}", f"agent_{k}{5500 + i}", f"0{170 + k}/555{i:04}")[i % 3]
    rows, planted = [], {}
    for k, (before, after) in enumerate(phrases):
        for i in range(12):
            rows.append((1000 * k + i, " ".join([*prose(12), before, seed(k, i), after, *prose(9)])))
        for i in range(20):
            rows.append((1000 * k + 100 + i, " ".join([*prose(12), before, unseen(k, i), after, *prose(9)])))
            planted[1000 * k + 100 + i] = unseen(k, i)
    card = lambda ok: next(c for c in iter(lambda: "".join(draw.choices("0123456789", k=16)), "") if luhn(c) == ok)
    rows += [(9000 + i, " ".join([*prose(8), card(i % 2 == 0), *prose(8)])) for i in range(200)]
    rows += [(9500 + i, " ".join([*prose(8), draw.choice(["in the year", "it costs", "some"]), str(1900 + i), *prose(8)])) for i in range(100)]
    texts, hits, wrong = dict(rows), set(), 0
    for r in pii.extract(docs(rows)).where("n_context > 0").collect():
        for kind, a, b in (x.split(":") for x in r.spans.split(",")):
            if kind == "context":
                right = texts[r.doc_id][int(a) : int(b)] == planted.get(r.doc_id)
                hits |= {r.doc_id} if right else set()
                wrong += not right
    assert len(hits) >= 0.95 * len(planted) and wrong <= 0.05 * len(planted)


# --- language -----------------------------------------------------------------------------------------------------------


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(language, "WINDOW", 7)
    rng = np.random.default_rng(0)
    net = language.Network.fresh(["a", "b", "c"], rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x = language.windows([b"abcabca", b"de", b"fab"])[0].T
    target = np.array([0, 1, 2])
    _, grads = net.gradients(x, target)
    used = np.unique(x[x < language.PAD])
    for k, w in net.weights.items():
        for _ in range(8):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if k[0] == "x":
                at = (int(rng.choice(used)), at[1])
            held, eps, out = w[at], 1e-5, []
            for d in (eps, -eps):
                w[at] = held + d
                out.append(net.gradients(x, target)[0])
            w[at] = held
            assert abs((out[0] - out[1]) / (2 * eps) - grads[k][at]) < 1e-8 + 1e-5 * abs(grads[k][at])


def test_every_position_is_labelled_as_by_single_steps():
    """The network against a plain reading of its definition, one byte and one gate at a time."""
    rng = np.random.default_rng(1)
    net, h = language.Network.fresh(["a", "b"], rng), language.HIDDEN
    texts = [b"some words here", b"x" * 130, "é1!".encode()]
    x, many = language.windows(texts)
    assert many.tolist() == [1, 3, 1] and x.shape == (5, language.WINDOW)
    logistic = lambda v: 1 / (1 + np.exp(-v))
    got, w = net.labels(np.ascontiguousarray(x.T)), {k: v.astype(np.float64) for k, v in net.weights.items()}
    for i, window in enumerate(x):
        states = {}
        for d, order in (("f", range(len(window))), ("b", reversed(range(len(window))))):
            state = np.zeros(h)
            for t in order:
                own = w[f"x{d}"][window[t]] + (w[f"b{d}"] if window[t] < language.PAD else 0)
                back = state @ w[f"h{d}"]
                z, r = logistic(own[:h] + back[:h]), logistic(own[h : 2 * h] + back[h : 2 * h])
                n = np.tanh(own[2 * h :] + r * back[2 * h :])
                state = (1 - z) * n + z * state
                states[d, t] = state
        for t in range(len(window)):
            y = np.concatenate([states["f", t], states["b", t]]) @ w["o"] + w["c"]
            p = np.exp(y - y.max()) / np.exp(y - y.max()).sum()
            assert np.allclose(got[t, :, i], p, atol=1e-4)


def language_rows(n=160):
    draw = random.Random(6)
    vocab = {"en": "the and with from there which about would this that have people".split(), "de": "der die und nicht mit einer werden auch über schön zwischen können".split(), "es": "el la los una pero también porque años señor donde cuando mucho".split()}
    return [(i, " ".join(draw.choices(vocab[lang], k=draw.randrange(4, 40))), lang) for i in range(n) for lang in [draw.choice(list(vocab))]]


def test_language_learns_and_defines_odd_rows(docs):
    rows = language_rows()
    odd = [(1001, None, "en"), (1002, "12 34 !!", "de"), (1003, "THE AND WITH " * 9000, None), (None, "der die und nicht", "de"), (1003, "THE AND WITH " * 9000, None)]
    got = language.identify(docs([*rows, *odd])).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert sum(by[i].lang_pred == lang for i, _, lang in rows) >= 0.97 * len(rows)
    assert [by[i].lang_pred for i in (1001, 1002, 1003, None)] == ["und", "und", "en", "de"] and by[1001].score == 0 and not by[None].held_out
    import zlib

    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows) and all(0 <= r.score <= 1 for r in got)


def test_language_without_labels(docs):
    assert [r.lang_pred for r in language.identify(docs([(1, "some words", None)])).collect()] == ["und"]
    assert language.identify(docs([])).count() == 0
