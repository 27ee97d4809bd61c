from barspark.llm import quotation


def test_links_threads_and_bodies(spark):
    rows = [
        (1, 0, "user", "First question?\nSecond line."),
        (1, 1, "assistant", "On 1 May u wrote:\n> first  QUESTION?\nAn answer is here.\nMore."),
        (1, 2, "user", ">> First question?\n> An answer\n> is here.\nThanks.\n"),
        (1, 3, "user", "> Second line.\n> second line.\n> More.\nOther branch"),
        (1, 4, "user", "> Thanks.\nDeep"),
        (1, 5, "user", "> unknown\nNew thread"),
        (1, 6, None, None),
        (2, 0, "user", "> First question?\nother conversation"),
        (2, 1, "user", "> other conversation"),
        (3, 0, "user", "x > y\n  > > quoted"),
        (None, 0, "user", "> a\nb"),
        (4, None, "user", ""),
        (5, 0, "user", "same"), (5, 0, "user", "same"), (5, 1, "user", "> same\n" + "w " * 50000),
    ]
    frame = spark.createDataFrame([(*r, 1, "b") for r in rows], "conv_id long, turn long, role string, text string, root int, body string")
    got = quotation.conversations(frame).collect()
    assert len(got) == len(rows)
    of = {(r.conv, r.turn): r for r in got}
    want = {(1, 0): (None, 0, 0), (1, 1): (0, 0, 1), (1, 2): (1, 0, 2), (1, 3): (0, 0, 1), (1, 4): (2, 0, 3), (1, 5): (None, 5, 0), (2, 0): (None, 0, 0), (2, 1): (0, 0, 1), (5, 1): (0, 0, 1)}
    for k, v in want.items():
        assert (of[k].parent, of[k].root, of[k].depth) == v, k
    assert of[1, 2].body == "Thanks." and of[1, 2].n_quoted == 3 and of[1, 6].body == "" and of[3, 0].body == "x > y"
    ordered = quotation.in_reply_order(quotation.conversations(frame)).collect()
    assert len(ordered) == len(rows) and [r.turn for r in ordered if r.conv == 1] == [0, 1, 2, 3, 4, 5, 6] and of[1, 1].body == "An answer is here.\nMore."
    assert of[1, 4].formatted == "<|user|>\nDeep\n"
    assert quotation.conversations(frame.limit(0)).count() == 0


def test_deeper_levels_short_lines_and_nested_attributions(spark):
    rows = [
        (0, "yes\nThe very first statement stands here."), (1, "yes\nSomething else entirely is said."), (2, ">> the very first\n>> statement stands here.\nOnly an older one is quoted."),
        (3, "> yes\nwho said so"), (4, "> On May 1 x wrote:\n>> The very first statement stands here.\n> Something else entirely is said.\nboth"),
        (5, "he wrote:\nno quotation follows"), (6, "> who said so\n> who said so\nshort"), (7, "> short\nend"),
    ]
    frame = spark.createDataFrame([(1, t, "u", x) for t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.parent, r.root, r.body) for r in quotation.conversations(frame).collect()}
    assert got[2] == (0, 0, "Only an older one is quoted.")  # level 2 leads to an ancestor
    assert got[3][0] is None  # a short line of two messages leads nowhere
    assert got[4] == (1, 1, "both") and got[5] == (None, 5, "he wrote:\nno quotation follows")
    assert got[6][0] is None and got[7] == (6, 6, "end")  # all of a message's own text does, however short


def test_attributions_over_two_lines(spark):
    rows = [
        (0, "The statement that they all answer."),
        (1, "On Mon, x\nwrote:\n> The statement that they all answer.\none"),
        (2, "Hello,\nAm 5. Mai 2024 um 10:15\nEva Muster schrieb:\n> The statement that they all answer.\ntwo"),
        (3, "On the whole, I agree.\nShe wrote:\n> The statement that they all answer.\nthree"),  # a sentence is no half of one
        (4, "On Mon, x\nwrote:\nno quotation follows"),
        (5, "> On Mon, x\n> wrote:\n>> The statement that they all answer.\n> two\nfive"),
        (6, "> On Mon, x\nwrote:\n>> The statement that they all answer.\nsix"),  # halves of two levels
        (7, "On Mon, x\nwrote:"),
    ]
    frame = spark.createDataFrame([(1, t, "u", x) for t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.parent, r.body) for r in quotation.conversations(frame).collect()}
    assert got[1] == (0, "one") and got[2] == (0, "Hello,\ntwo") and got[3] == (0, "On the whole, I agree.\nthree")
    assert got[4] == (None, rows[4][1]) and got[7] == (None, rows[7][1])
    assert got[5] == (0, "five") and got[6] == (0, "wrote:\nsix")
