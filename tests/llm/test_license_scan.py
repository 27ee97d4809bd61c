import random
import re

from barspark.llm import license_scan, queries

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_places(text, phrases):
    words = WORDS.findall(lower(text))
    found = []
    for phrase, label in phrases.items():
        want = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    return len(words), sorted(found)


def parsed(tokens):
    """By recursive descent: (names, level), or None if the whole isn't well-formed."""
    at = 0

    def primary():
        nonlocal at
        if at >= len(tokens) or tokens[at] in (")", "and", "or", "with"):
            raise SyntaxError
        at += 1
        if tokens[at - 1] != "(":
            return {tokens[at - 1]}, license_scan.level_of(tokens[at - 1])
        inner = chain("or")
        if at >= len(tokens) or tokens[at] != ")":
            raise SyntaxError
        at += 1
        return inner

    def excepted():
        nonlocal at
        names, level = primary()
        while at < len(tokens) and tokens[at] == "with":
            at += 1
            if at >= len(tokens) or tokens[at] in ("(", ")", "and", "or", "with"):
                raise SyntaxError
            names, level, at = names | {tokens[at]}, max(min(level, 20), level - 30), at + 1
        return names, level

    def chain(word):
        nonlocal at
        below = (lambda: chain("and")) if word == "or" else excepted
        names, level = below()
        while at < len(tokens) and tokens[at] == word:
            at += 1
            more, other = below()
            names, level = names | more, (min if word == "or" else max)(level, other)
        return names, level

    try:
        found = chain("or")
    except SyntaxError:
        return None
    return found if at == len(tokens) else None


def test_expressions_agree_with_recursive_descent():
    rng = random.Random(7)
    for _ in range(4000):
        tokens = rng.choices(["(", ")", "and", "or", "with", "mit", "gpl-2.0", "lgpl-2.1", "odd"], k=rng.randrange(0, 9))
        want = next((p for n in range(len(tokens), 0, -1) if (p := parsed(tokens[:n]))), None)
        got = license_scan.evaluate(tokens)
        assert (got and (set(got[0]), got[1])) == want, tokens


def test_values_of_expressions():
    of = lambda text: license_scan.evaluate(text.lower().replace("(", "( ").replace(")", " )").split())
    assert of("MIT OR GPL-3.0-only AND Apache-2.0") == ({"mit", "gpl-3.0-only", "apache-2.0"}, 20)
    assert of("(MIT OR GPL-3.0-only) AND AGPL-3.0-only")[1] == 90
    assert of("GPL-2.0-or-later WITH Classpath-exception-2.0") == ({"gpl-2.0-or-later", "classpath-exception-2.0"}, 50)
    assert of("MIT is free")[0] == {"mit"} and of("or MIT") is None and of("()") is None
    assert license_scan.level_of("cc-by-nc-4.0") == 90 and license_scan.level_of("cc-by-4.0") == 20 and license_scan.level_of("mitx") == license_scan.UNKNOWN
    assert of("(" * 30000 + "mit" + ")" * 30000)[0] == {"mit"}


def test_places_agree_with_brute_force():
    rng = random.Random(2)
    pieces = ["gnu", "General", "PUBLIC", "license", "apache", "cc", "by", "nc", "mit", "version", "2", "0", "é", "x", "cc0"]
    for _ in range(800):
        text = "".join(rng.choice(pieces) + rng.choice([" ", "-", "\n", ", ", "_", "\x7f", " " if rng.random() < 0.2 else " "]) for _ in range(rng.randrange(0, 60)))
        n, places = license_scan.found_in(text.encode())
        assert n == len(WORDS.findall(lower(text)))
        for kind, phrases in (("base", license_scan.BASE), ("notice", license_scan.NOTICES)):
            assert sorted((w, label) for k, w, label, _ in places if k == kind) == brute_places(text, phrases)[1]


def test_tags_edges_and_clashing_columns(spark):
    long = "x " * 300_000 + "MIT License " + "y" * 500_000 + " apache\n\nLICENSE"
    texts = {
        1: "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause */\nint main", 2: None, 3: "", 4: " \n-", 5: long, 6: "MIT License MIT license",
        7: "SPDX-License-Identifier is a tag", 8: '"license expression" = "Apache-2.0 WITH LLVM-exception"', 9: "spdx license identifier: and", 10: "CC BY-NC 4.0",
    }
    docs = spark.createDataFrame([(k, v, 1, "b") for k, v in texts.items()] + [(None, "mit license", 2, "c")] * 2, "doc_id long, text string, places int, id string")
    got = license_scan.scan(docs).collect()
    assert len(got) == len(texts) + 2
    of = {r.id: (r.n_words, [(p.kind, p.word, p.label, p.level) for p in r.places]) for r in got}
    assert [p for p in of[1][1] if p[0] == "tag"] == [("tag", 0, x, 20) for x in ("bsd-3-clause", "gpl-2.0-only", "mit")]
    assert of[2] == of[3] == of[4] == (0, []) and of[None] == (2, [("base", 0, "mit", 20)])
    assert of[5][1] == [("base", 300_000, "mit", 20), ("base", 300_003, "apache", 20)]
    assert [p[1] for p in of[6][1]] == [0, 2] and of[7][1] == [] and of[9][1] == []
    assert of[8][1] == [("tag", 0, "apache-2.0", 20), ("tag", 0, "llvm-exception", 20)]
    assert sorted(p[2] for p in of[10][1]) == ["cc-by", "cc-by-nc"]
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_whole_table(spark, sf):
    rows = {r.doc_id: r for r in queries.op11_license_scan(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n, places = brute_places(d.text, license_scan.BASE)
        more = brute_places(d.text, license_scan.NOTICES)[1]
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert r.labels == ",".join(sorted({label for _, label in places + more}))  # the table has no tags
        assert r.score == max([license_scan.level_of(label) for _, label in places + more], default=0) / 100
    assert any(r.base_labels for r in rows.values())
