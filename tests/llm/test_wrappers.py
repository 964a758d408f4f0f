import random

from siltstone.llm import wrappers
from siltstone.llm.wrappers import align, segmented

NOUNS = "crane bell storm ledger mill quay valley winter granary beacon kiln orchard".split()


def sentence(rng, n=12):
    return f"{' '.join(rng.choices(NOUNS, k=n)).capitalize()}."


def site(rng, host, pages, html=True):
    brand, rows, want = host.split(".")[0].capitalize(), [], {}
    for i in range(pages):
        title = f"{rng.choice(NOUNS)} {rng.choice(NOUNS)} {rng.choice(NOUNS)} report {rng.random():.6f}"
        lines = [("x", f"{brand} uses cookies to remember your settings."), ("x", "Home"), ("x", "Programmes"), ("x", f"Home » Programmes » {title}"), (" ", title), ("x", f"By {rng.choice(['Ada', 'Ivo'])} Lonker{rng.choice('abc')}")]
        lines += [(" ", sentence(rng, 14)), ("x", f"Shared {rng.randint(1, 900)} times"), (" ", f"Limits of the {' '.join(rng.choices(NOUNS, k=5))}"), (" ", sentence(rng, 16))]
        lines += [(" ", f"{' '.join(rng.choices(NOUNS, k=3))} | {' '.join(rng.choices(NOUNS, k=3))} | {rng.randint(1, 9999)} tons"), ("x", "You may also like")]
        related = [f"How {' '.join(rng.choices(NOUNS, k=6))}" for _ in range(3)]
        lines += [("x", r) for r in related] + [("x", f"© {rng.randint(2000, 2030)} {brand}. All rights reserved.")]
        url = f"https://{host}/{i}"
        markup = "<body>\n" + "\n".join(f'<a href="/r">{t}</a>' if t in related else f"<p>{t}</p>" for _, t in lines) if html and i % 3 else None
        rows.append((url, url, f"{title} - {brand}", markup, "\n".join(t for _, t in lines), None))
        want[url] = [k for k, (m, _) in enumerate(lines) if m == "x"]
    return rows, want


def test_align_keeps_order_and_adds_optional_tokens():
    assert align([1, 2, 3], [1, 9, 3]) == [1, 2, 9, 3] or align([1, 2, 3], [1, 9, 3]) == [1, 9, 2, 3]
    assert align([], [4, 5]) == [4, 5] and align([1, 2], []) == [1, 2]
    assert align([1, 2, 3], [3, 1, 2]) == [1, 2, 3]


def test_segments_of_sites(pages):
    rng = random.Random(3)
    rows, want = [], {}
    for host, n in (("alphaport.example", 30), ("betamill.example", 30), ("gammafarm.example", 30), ("deltaquay.example", 2)):
        r, w = site(rng, host, n, host != "deltaquay.example")
        rows, want = rows + r, want | w
    rows += [("https://alphaport.example/none", None, None, None, None, None), ("https://alphaport.example/msg", None, "gone - Alphaport", None, "404 - Page not found\n\nAlphaport uses cookies to remember your settings.", None)]
    got = {r.url: sorted(r.outside) for r in segmented(pages(rows)).collect()}
    assert got.pop("https://alphaport.example/msg") == [2] and "https://alphaport.example/none" not in got
    wrong = {u: (got[u], want[u]) for u in want if got[u] != want[u]}
    assert not wrong, list(wrong.items())[:3]


def test_buckets_of_one_site_agree(pages, monkeypatch):
    rows, want = site(random.Random(4), "alphaport.example", 60)
    monkeypatch.setattr(wrappers, "BUCKET", 20)
    got = {r.url: sorted(r.outside) for r in segmented(pages(rows)).collect()}
    assert got == want


def test_very_long_and_empty_texts(pages):
    rows = [("https://a.example/1", None, None, "<a", "word " * 200_000, None), ("https://a.example/2", None, None, None, "", None), ("u", "::", None, None, "\n\n", None)]
    got = {r.url: (list(r.outside), list(r.body)) for r in segmented(pages(rows)).collect()}
    assert got == {"https://a.example/1": ([], [0]), "https://a.example/2": ([], []), "u": ([], [])}
    assert segmented(pages(rows).limit(0)).count() == 0


def test_path_of_a_page_without_title(pages):
    rows, want = site(random.Random(5), "alphaport.example", 40)
    url, final, _, html, text, day = rows[0]
    rows[0] = (url, final, None, html, text, day)
    got = {r.url: sorted(r.outside) for r in segmented(pages(rows)).collect()}
    assert got == want


def test_one_page_of_a_site_takes_the_frames_of_others(pages):
    rng, rows = random.Random(6), []
    notice, prompt = "We and our partners store cookies on this device.", "Please sign in to read more"
    for host in ("alphaport.example", "betamill.example", "gammafarm.example"):
        for i in range(8):
            lines = [f"{' '.join(rng.choices(NOUNS, k=4))} report {rng.random():.6f}", sentence(rng, 14), prompt, sentence(rng, 15), notice]
            rows.append((f"https://{host}/{i}", None, lines[0], None, "\n".join(lines), None))
    copied = sentence(rng, 20)  # one text on one page of each of four sites is no frame
    for host in ("deltaquay.example", "epsilonfen.example", "zetamoor.example", "etaglen.example"):
        rows.append((f"https://{host}/1", None, "Crane and quay report", None, f"Crane and quay report\n{notice}\n{copied}\n{prompt}\n{sentence(rng, 16)}", None))
    rows.append(("https://deltaquay.example/2", None, "Kiln report", None, f"Kiln report\n{sentence(rng, 16)}\n{prompt}", None))
    got = {r.url: sorted(r.outside) for r in segmented(pages(rows)).collect()}
    assert all(got[f"https://{h}.example/1"] == [1, 3] for h in ("deltaquay", "epsilonfen", "zetamoor", "etaglen"))
    assert got["https://deltaquay.example/2"] == [2] and got["https://alphaport.example/1"] == [2, 4]


def menu_site(rng, n=30):
    """Pages with a menu of lines, a body whose section may be called like a menu entry, and a section that half of them have."""
    menu, rows, want = ["Home", "Programmes", "Contact"], [], {}
    for i in range(n):
        title = f"{' '.join(rng.choices(NOUNS, k=4))} report {rng.random():.6f}"
        lines = [("x", m) for m in menu] + [(" ", title), (" ", sentence(rng, 14))]
        lines += [(" ", "Programmes")] if i == 7 else []
        lines += [(" ", sentence(rng, 13))]
        lines += [(" ", "What the members say"), (" ", sentence(rng, 15))] if i % 2 else []
        lines += [("x", "Nothing here is advice to anyone at all.")]
        url = f"https://thetapeak.example/{i}"
        tags = {"What the members say": "h2", title: "h1"}
        html = "<body>\n" + "\n".join(f'<a href="/">{t}</a>' if t in menu and k < 3 else f"<{tags.get(t, 'p')}>{t}</{tags.get(t, 'p')}>" for k, (_, t) in enumerate(lines))
        rows.append((url, url, title, html if i % 3 else None, "\n".join(t for _, t in lines), None))
        want[url] = [k for k, (m, _) in enumerate(lines) if m == "x"]
    return rows, want


def test_the_place_in_the_wrapper_decides(pages, monkeypatch):
    rows, want = menu_site(random.Random(8))
    rows += [(u.replace("theta", x), f.replace("theta", x), *r) for x in ("iota", "kappa") for u, f, *r in menu_site(random.Random(9))[0] if "/7" not in u]
    df = pages(rows)
    got = {r.url: sorted(r.outside) for r in segmented(df).collect()}
    assert {u: got[u] for u in want} == want
    streams = [wrappers.stream(r[4], r[2], r[3], "thetapeak.example") for r in rows[:30]]
    wrapper, stats, _ = wrappers.induce(streams)
    foot = streams[0][0][-1]
    assert foot in wrapper and stats[foot][0] == 30
    frame = {foot: (False, False)}
    assert want[rows[1][0]][-1] in wrappers.outside(streams[1], wrapper, frame)
    # Without the alignment no literal has support, so that no line is a frame.
    monkeypatch.setattr(wrappers, "align", lambda wrapper, tokens: [])
    wrapper, stats, _ = wrappers.induce(streams)
    assert wrapper == [] and foot not in stats


def test_induced_wrapper_tells_order_repeats_and_slots():
    streams = [([5, 6, 10 + i, 7], [3, 4, 2, 4], {}, {}) for i in range(4)] + [([6, 5, 20, 7, 7], [4, 3, 2, 4, 4], {}, {})]
    wrapper, stats, single = wrappers.induce(streams)
    assert wrapper == [5, 6, 7] and sorted(single) == [10, 11, 12, 13, 20]
    n = {k: dict(zip(wrappers.STATS, v)) for k, v in stats.items()}
    assert n[5]["n"] + n[6]["n"] == 9 and n[5]["loose"] + n[6]["loose"] == 1  # one of the two stands out of order once
    assert n[7]["n"] == 5 and n[7]["loose"] == 1 and n[7]["places"] == 6 and n[6]["prose"] == 4


def test_rows_stay_bounded_on_a_large_site(pages, monkeypatch):
    monkeypatch.setattr(wrappers, "BUCKET", 32)
    sizes = []
    for n in (64, 512):
        rows = [(f"https://a.example/{i}", None, None, f'<p>\n<a href="/">Alpha story {i:x} of the quay z{i:x}</a>\n', f"Menu\nAlpha story {chr(97 + i % 26)}{i:x}q of the quay\nWords of page q{i:x} and more.", None) for i in range(n)]
        parts = wrappers.buckets(pages(rows))
        sizes.append(max(len(r.frame) for r in wrappers.frames(parts).collect()))
    assert sizes[1] <= 2 * sizes[0]
