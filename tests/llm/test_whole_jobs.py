"""Operators over whole texts and groups, against brute force on small rows."""


def named(spark, texts, templates=None):
    from beaconq.llm import licences

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in licences.scan(frame, templates or licences.TEMPLATES).collect():
        found.setdefault(r["doc_id"], []).append((r["line"], r["licence"], round(r["dice"], 9)))
    return [sorted(found.get(i, [])) for i in range(len(texts))]


def test_licences_within_lines_across_lines_and_in_full(spark):
    from beaconq.llm.licence_texts import TEXTS

    got = named(
        spark,
        [
            "Hello.\nThis project is released under the MIT License; see the LICENSE file for details.",
            "a b c\nThis work is licensed under the GNU\n\nGeneral Public License, version 3.\nd e f",
            "One.\n\nAll rights reserved.",
            "Released under the MIT License. And more. Released under the MIT License.",
            "", "all rights, none reserved of the software", None, "rights " * 5000,
            *(f"Words before\n{text}\nand words after" for text in TEXTS.values()),
        ],
    )
    assert got[0] == [(2, "MIT", 1.0)] and (2, "GPL-3.0", 1.0) in got[1] and got[2] == [(3, "All-Rights-Reserved", 1.0)]
    assert got[3] == [(1, "MIT", 1.0)] * 2 and got[4:8] == [[]] * 4
    for name, rows in zip(TEXTS, got[8:]):
        assert (2, name, 1.0) in rows, name


def test_licences_equal_brute_force(spark):
    """Every window between ends of runs with every template, against random edits of short templates."""
    import random

    from beaconq.llm import licences

    templates = [("A", "one two three four five six"), ("A", "one two three nine"), ("B", "six seven eight two three")]
    rng = random.Random(8)
    words = "one two three four five six seven eight nine ten".split()

    def text():
        found = []
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(templates)[1].split() if rng.random() < 0.8 else rng.choices(words, k=5)
            found += [w for w in part if rng.random() > 0.1] + rng.choices(words, k=rng.randint(0, 3))
        return "".join(w + rng.choice([" ", ", ", "\n"]) for w in found)

    texts = [text() for _ in range(120)]

    def brute(text):
        at = [(m.group(), text.count("\n", 0, m.start()) + 1) for m in __import__("re").finditer(r"[a-z0-9]+", text)]
        grams = [f"{a} {b}" for (a, _), (b, _) in zip(at, at[1:])]
        found = []
        for k, (name, template) in enumerate(templates):
            t = set(licences.bigrams_in(template))
            lo, _ = licences.size_bounds(len(t), 0.8)
            ends = [f"{a} {b}" for a, b in (template.split()[:2], template.split()[-2:])]
            hit = [g in t for g in grams] + [False]
            starts = [i for i, g in enumerate(grams) if hit[i] and (not i or not hit[i - 1] or g == ends[0])]
            stops = {i + 1 for i, g in enumerate(grams) if hit[i] and (not hit[i + 1] or g == ends[1])}
            for a in starts:
                for b in {*range(a + lo, len(grams) + 1)} & stops:
                    part = set(grams[a:b])
                    if (dice := 2 * len(part & t) / (len(part) + len(t))) >= 0.8:
                        found.append((-dice, a - b, a, k, name, b))
        best = [w for w in found if not any(o[:4] < w[:4] and o[4] == w[4] and o[2] < w[5] and w[2] < o[5] for o in found)]
        return sorted((at[a][1], name, round(-dice, 9)) for dice, _, a, _, name, _ in best)

    assert named(spark, texts, templates) == [brute(t) for t in texts]


def test_rewrites_far_back_are_seen(spark):
    from beaconq.llm import chat

    def numbers_first(turns):
        """The first turn tells whether there are over 140."""
        return "".join(f"{'long' if i == 0 and len(turns) > 140 else 'turn'}:{text};" for i, (_, text) in enumerate(turns))

    def once(turns):
        return "".join(f"{'<bos>' if i == 0 else ''}{text};" for i, (_, text) in enumerate(turns))

    frame = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(150)], "conv_id long, turn long, role string, text string")
    found = chat.format_turns(frame, numbers_first).filter("rewrites_history").collect()
    assert [r["nth"] for r in found] == [140]
    pieces = [r["piece"] for r in sorted(chat.format_turns(frame, once).collect(), key=lambda r: r["nth"])]
    assert pieces == ["<bos>t0;", *(f"t{i};" for i in range(1, 150))]


def test_each_group_of_near_copies_keeps_its_first_row(spark):
    from beaconq.llm import simhash

    a, b, c = ("alpha beta gamma delta", "one two three four five", "un deux trois quatre")
    rows = [(1, a), (1, b), (2, b), (3, a), (None, c), (None, c), (None, a), (1, a)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(1, a), (1, b), (0, c)])
