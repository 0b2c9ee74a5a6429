import hashlib
import random
import re

from pyspark.sql import functions as F

from tesserae.llm import personal_data as p

#: The contract's patterns as they stand, for a plain loop.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ODD = [
    "", "a@b.c_d@e.f x@y", "é+1 (743) 555-3824 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "1" * 30_000, "1.1." * 3000, "a" * 50_000 + "@" + "b.c" * 10,
    "+1" + " " * 20_000, "x@y.z_w@q.r +12+34567890123 5", "😀 a@b.cd 😀 10.0.0.1", "12 " * 5000, "a@b@c.d a.@.b -@-.-", "+1 22 33 44 5555 6666 77 88 +44 1234567", "0.0.0.256 000.0.0.0000255",
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def plain_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
            if good:
                found.append((m.start(), k, m.end(), kind))
    return sorted(found)


def test_base_spans(spark, tmp_path):
    docs = [(i, x) for i, x in enumerate(ODD)] + [(None, None), (3, ODD[3])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = p.op5_contextual_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    made = {r.doc_id: r for r in rows}
    for i, x in docs:
        spans = plain_spans(x or "")
        text = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)
        assert made[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and made[i].spans == text
        assert [made[i][f"n_{k}"] for k in PLAIN] == [sum(s[3] == k for s in spans) for k in PLAIN]


def test_unseen_identifiers_are_found_by_context(spark):
    docs = [f"please write to contact {k}name{k}@mail{k}.example.com for account help today" for k in range(30)]
    docs += ["please write to contact AB-9912-77 for account help", "the year 199912 was long", "see figure 123456 there", "contact nobody12345 about it"]
    rows = p.find_personal_data(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).select("doc_id", F.col("added")).collect()
    added = {r.doc_id: [(s.start, s.end) for s in r.added] for r in rows if r.added}
    at = docs[30].index("AB-9912-77")
    assert added == {30: [(at, at + 10)]}


def test_empty_table(spark):
    assert p.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_base_spans_are_seeds(spark):
    """Emails without digits and phone numbers with blanks teach patterns."""
    letters = "abcdefghijklmnopqrst"
    docs = [f"please write to contact {a}.doe@example.com for account help" for a in letters] + [f"you can ring +1 415 555 01{k:02} (at) any hour" for k in range(20)]
    docs += ["please write to contact AB-9912-77 for account help", "you can ring XY-12345 (at) any hour", "you can ring 123456 instead"]
    rows = p.find_personal_data(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    added = {r.doc_id: [docs[r.doc_id][s.start : s.end] for s in r.added] for r in rows if r.added}
    assert added == {40: ["AB-9912-77"], 41: ["XY-12345"]}


def test_found_identifiers_bring_in_patterns(spark):
    """A chain of five hops: what stands in one hop's context leads to the next context."""
    docs = [f"start lefta {a}{b}@example.com righta end" for a in "abcdef" for b in "uvwxyz"]
    for hop, (here, then) in enumerate(zip("abcde", "bcdef", strict=True)):
        for k in range(8):
            docs += [f"start left{here} ID-{hop}-77{k} right{here} end"] + [f"start left{then} ID-{hop}-77{k} right{then} end"] * 6
    docs += ["start leftf LAST-4711 rightf end", "start leftf LONE-4711 other end"]
    rows = p.find_personal_data(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    found = {docs[r.doc_id][s.start : s.end] for r in rows for s in r.added}
    assert found == {f"ID-{hop}-77{k}" for hop in range(5) for k in range(8)} | {"LAST-4711"}


def loop(rows):
    """Patterns, scores and accepted keys by plain dictionaries, from rows (key, patterns, seed, span)."""
    times, seed, span = {}, {}, {}
    for key, patterns, s, own in rows:
        for x in patterns:
            times[x, key] = times.get((x, key), 0) + 1
            seed[x, key], span[x, key] = seed.get((x, key), False) or s, span.get((x, key), False) or own
    always = {k for (_, k), s in seed.items() if s}
    score, sure, last, rounds = dict.fromkeys(always, 1.0), set(always), (0, 0, 0.0), []
    while True:
        good = {}
        for x in {x for x, _ in times}:
            own = [(k, n) for (y, k), n in times.items() if y == x]
            confidence = sum(n * score.get(k, 0.0) for k, n in own) / (sum(n for _, n in own) + p.DAMPING)
            if confidence >= p.CONFIDENT and sum(k in sure for k, _ in own) >= p.LEAST_SEEDS:
                good[x] = confidence
        found, accepted = {}, set()
        for k in {k for (x, k), own in span.items() if own and x in good}:
            by = {}
            for (x, y), own in span.items():
                if y == k and own and x in good:
                    by[x[0]] = max(by.get(x[0], 0.0), good[x])
            miss = 1.0
            for side in "=<>":
                miss *= 1 - by.get(side, 0.0)
            found[k] = 1 - miss
            if ("=" in by or len(by) == 2) and found[k] >= p.ACCEPT:
                accepted.add(k)
        now = (len(good), len(accepted), sum(good.values()))
        rounds.append(now[:2])
        if now[:2] == last[:2] and now[2] - last[2] <= p.SETTLED * max(1, now[0]):
            return accepted, rounds
        last, sure = now, always | accepted
        score = {k: max(found.get(k, 0.0), 1.0 if k in always else 0.0) for k in set(found) | always}


def test_scoring_against_a_loop(spark):
    """Random graphs: the same identifiers and the same numbers in every round; and the yield rises from round to round."""
    rng, rising = random.Random(14), 0
    for _ in range(3):
        rows = []
        for _ in range(700):
            k = rng.randrange(90)
            near = [(k // 15 + d) % 6 for d in (0, 0, 0, 1)]  # identifiers share contexts with their neighbours
            rows.append((k, [f"{'=' if rng.random() < 0.1 else '<'}{rng.choice(near)}", f">{rng.choice(near)}"], k < 18 and rng.random() < 0.9, k >= 15))
        frame = spark.createDataFrame(rows, "key long, patterns array<string>, seed boolean, span boolean")
        rounds = []
        found = {r.key for r in p.discovered(frame, lambda *x: rounds.append(x)).collect()}
        assert (found, rounds) == loop(rows)
        rising += len({x[1] for x in rounds}) > 2 and rounds == sorted(rounds)
    assert rising


def test_secrets_after_a_label_and_wide_contexts(spark):
    """Shapes of keys teach the label before them; then what stands after the label is found whatever its shape."""
    rng = random.Random(15)
    name = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    docs = [f"word{name(k)} text here token = \"{rng.randbytes(20).hex()}\" {name(k)}x more" for k in range(30)]
    docs += ["some text here token = \"pin-4711-88\" so on", "some text there total = 123456 so on", "x" * 200 + " = \"plain-123\" y", "no " * 30_000 + "token = \"late-98765\" end"]
    rows = p.find_personal_data(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    added = {r.doc_id: [docs[r.doc_id][s.start : s.end] for s in r.added] for r in rows if r.added}
    assert all(len(added[k]) == 1 for k in range(30)) and added[30] == ['"pin-4711-88"'] and added[33] == ['"late-98765"'] and set(added) == {*range(31), 33}
