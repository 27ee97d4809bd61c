import re
from collections import Counter

from barspark.llm import line_rules


def brute(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    n = Counter(grams)
    hit = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_counts_and_verdicts(spark):
    clean = "One two three four five six seven eight nine ten eleven, and more of it.\n\nAnother line here."
    texts = {
        1: clean, 2: None, 3: "", 4: " \x0b\x0c\t", 5: "a b c d e a b c d e a b c d e", 6: clean + "\nAll rights reserved.",
        7: "Home | About | News | Shop\nSt | or | he | an | th | sh | be | me | x | y", 8: "ST!! THE!! OF!! A!! B!! C!! D!! E!! F!! G!! H!!",
        9: "de%%% la&&& x$$$ y*** q### " * 4, 10: "x y\nx y\n x y\nx y\n", 11: clean + "\n" + clean, 12: "ü é " * 6, 13: "a b c d e a b c d e",
        14: " ".join(str(i) for i in range(60000)),
    }
    docs = spark.createDataFrame([(k, v, "w", 3) for k, v in texts.items()] + [(None, clean, "w", 3)], "doc_id long, text string, w string, lines int")
    got = {r.id: r for r in line_rules.clean(docs).collect()}
    for k, v in texts.items():
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(v), k
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert [k for k in sorted(texts) if got[k].kept] == [1, 6, 14]
    assert got[None].kept and got[6].cleaned == clean
    assert not any(got[k].kept for k in (2, 3, 4, 5, 7, 8, 9, 10))
    assert line_rules.clean(docs.limit(0)).count() == 0


def test_a_mention_in_a_long_line_and_dotted_names(spark):
    line, more = " ".join(f"word{i}" for i in range(60)), " ".join(f"term{i}" for i in range(60))
    texts = {1: f"{line} copyright {more}", 2: f"{line} a | b | c {more}", 3: f"copyright notice {' '.join(line.split()[:12])}", 4: f"{line} | x | y | {more}\nPrivacy policy"}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, `m.k` int")
    got = {r.id: (r.kept, r.cleaned, r.row["m.k"]) for r in line_rules.clean(docs, carry=True).collect()}
    assert got == {1: (True, texts[1], 1), 2: (True, texts[2], 1), 3: (False, "", 1), 4: (True, texts[4].split("\n")[0], 1)}


def test_lines_in_the_languages_of_the_table(spark):
    body, end = " ".join(f"wort{i}" for i in range(14)), " ".join(f"ende{i}" for i in range(14))
    gone = ["STARTSEITE", "Menü", "MENÚ", " Über uns ", "ÜBER UNS.", "Zurück", "Précédent", "S’inscrire", "À propos", "Leer más", "Contacto:",
            "Alle Rechte vorbehalten 2020", "© 2021 Tous DROITS RÉSERVÉS", "Conditions générales d'utilisation", "Política de privacidad", "Términos y condiciones"]
    stay = ["weiter geht es", "Der Kontakt ist gut", "une recherche longue", f"{' '.join(f'a{i}' for i in range(30))} Datenschutzerklärung", "Menues", "Urheberrecht"]
    docs = spark.createDataFrame([(n, f"{body}\n{line}\n{end}") for n, line in enumerate(gone + stay)], "doc_id long, text string")
    got = {r.id: (r.kept, r.cleaned.split("\n")[1:-1]) for r in line_rules.clean(docs).collect()}
    assert got == {n: (True, [] if n < len(gone) else [line]) for n, line in enumerate(gone + stay)}
