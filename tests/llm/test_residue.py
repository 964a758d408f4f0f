import pytest

from siltstone.llm.residue import _SHAPE, Scorer, counted, has_slot, judged, p3_found, train

PROSE = "\n".join(
    f"{a} report that the {b} could not absorb {c} during the annual review, and the {b} was replaced before the reserve was published by {a.lower()}."
    for a in ("Auditors", "Regulators", "Insurers", "Grid operators", "Fleet managers", "Campus labs") for b in ("audit trail", "settlement ledger", "test harness", "payment desk", "oracle feed") for c in ("packet loss", "clock skew", "manual reconciliation", "vendor lock-in")
)
SCORER = Scorer(train(counted(PROSE), shape=counted(PROSE.encode().translate(_SHAPE))))


@pytest.mark.parametrize(
    "line, slot, filler",
    [
        ("Dear {{call_name}}, your request about the audit trail was filed.", True, False), ("Contact: NaN.", True, False), ("Budget: <%= amount %>. Contact: #{title}.", True, False),
        ("Apply to [CONTACT_MAIL] before %%DEADLINE%%.", True, False), ("The {title} supports mapping a ledger.", True, False), ('Receipts that printed the text "{{amount}}" were traced to a ledger.', False, False),
        ("Its contract emits `Paid{value}` for each audit trail.", False, False), ("test test test test test test", False, True), ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed do.", False, True),
        ("The auditors counted 12 pages of lorem ipsum in the draft report of the settlement ledger, a sign of manual reconciliation.", False, False), ("See [1] and the [EU] paper, f(x) = {a, b}.", False, False),
    ],
)
def test_judge(line, slot, filler):
    assert SCORER.judge(line)[:2] == (slot, filler)


def test_notices_cover_only_notices():
    for text in ("404 - Page not found", "Please enable JavaScript to continue using this application.", "Seite nicht gefunden. Die angeforderte Adresse existiert nicht (mehr)."):
        _, _, notice, size = SCORER.judge(text)
        assert notice == size, text
    text = "Error 503 became the most common answer of the payment desk during the annual review, according to regulators."
    assert SCORER.judge(text)[2] == 0


def test_blocks_and_lines(spark):
    long = PROSE * 30
    flags = SCORER.suspects(["", long + " {{call_name}} " + long, "plain words of the audit trail", "Contact: NaN."])
    assert not flags[0] and flags[1] and flags[3]
    ratios = spark.sparkContext.broadcast(SCORER.ratios)
    df = spark.createDataFrame([("a", "fine\n\nContact: NaN."), ("b", None), ("c", ""), ("d", "The audit trail was replaced.")], "k string, text string")
    rows = judged(df, "k", ratios).collect()
    assert [(r.k, [x.no for x in r.lines]) for r in rows] == [("a", [0, 2])]


def test_found_uses_the_body(spark, tmp_path, pages):
    menu = "Home | News | Contact"
    rows = [(f"https://a.example/{i}", None, f"Settlement ledger report {i} - A", None, f"{menu}\nSettlement ledger report {i}\n{PROSE.splitlines()[i]}", None) for i in range(12)]
    rows += [("https://a.example/e", None, "Audit trail report - A", None, f"{menu}\nAudit trail report\n503 Service temporarily unavailable. We are down for planned maintenance.", None), ("https://a.example/n", None, None, None, None, None)]
    rows += [("https://a.example/m", None, "Oracle feed report - A", None, f"{menu}\nOracle feed report\n{PROSE.splitlines()[3]}\n404 - Page not found", None)]
    pages(rows).write.parquet(f"{tmp_path}/crawl_cache.parquet")
    excerpts = [(str(i), x, f"https://{i}.example/") for i, x in enumerate(PROSE.splitlines())] + [("s", "Budget: {amount}.", None), ("s", "Budget: {amount}.", None), ("z", None, None), ("y", "", "")]
    spark.createDataFrame(excerpts, "evidence_id string, evidence_excerpt string, source_url string").write.parquet(f"{tmp_path}/canonical_evidence.parquet")
    assert sorted(map(tuple, p3_found(spark, str(tmp_path)).collect())) == [("canonical_evidence", "s"), ("crawl_cache", "https://a.example/e")]


@pytest.mark.parametrize(
    "text, slot",
    [
        ("Hello undefined, your order has shipped.", True), ("Welcome back null!", True), ("Our partner None will open the call.", True), ("Dear [FIRST NAME], thank you", True),
        ("Dear {first name},", True), ("Dear *|FNAME|*,", True), ("We met @Model.Name", True), ("Hi ${customer}, see <%= link %>.", True), ("Call &lt;phone_number&gt; or <office.mail>.", True),
        ("Born in undefined and raised in null.", True), ("NaN guests came.", True), ("The null hypothesis was kept.", False), ("The result is undefined.", False), ("None of the members came.", False),
        ("The call returns null or None.", False), ("An undefined term has no sense.", False), ("Use the <section> element; a <b>bold</b> word.", False), ("Mail ada@Example.Org about [EU] rules.", False),
        ("The set {a, b} and f(x) = {1}.", False), ("None were found in the report.", False), ("Some cells hold NaN values.", False), ("Undefined behaviour of the oracle is rare.", False),
    ],
)
def test_slots_that_no_list_holds(text, slot):
    assert has_slot(text) == slot
    assert not slot or SCORER.suspects([text])[0], "no window is hot"


# Messages that stand neither among the seeds nor in the test tables.
HELD_OUT = [
    "You must turn on JavaScript in your browser settings to use this web page.", "Sorry, this page could not be found. It may have been moved.", "The server is down for maintenance. Please try again in a few minutes.",
    "Access to this resource has been denied by the server.", "Please log in to your account to view this page.", "An unexpected error occurred on the server. Please try again later.", "Your browser is not supported. Please enable cookies.",
    "This domain is parked and for sale by its owner.", "Diese Seite existiert nicht mehr. Bitte versuchen Sie es später noch einmal.", "La page que vous cherchez n'existe pas.", "Error 500: el servidor no está disponible.",
]


def test_held_out_messages():
    found = [m for m in HELD_OUT if SCORER.judge(m)[2] == SCORER.judge(m)[3]]
    assert len(found) == len(HELD_OUT), set(HELD_OUT) - set(found)
    prose = ["The server room of the town hall was moved to the old mill in May.", "Auditors report that the payment desk could not absorb an error of the server during the annual review.", "Insurers wait until the maintenance of the oracle feed is published by regulators."]
    assert not any(SCORER.judge(p)[2] for p in prose)


def test_seeds_stand_in_no_table():
    """No seed sentence is a sentence of the test tables, so nothing is memorised."""
    import glob
    import re

    import pandas as pd

    from siltstone.llm import residue

    files = glob.glob("/root/testdata/sf0.01/c*_*.parquet")
    if not files:
        pytest.skip("no test tables")
    texts = [pd.read_parquet(f, columns=[c])[c].dropna() for f, c in ((f, c) for f in files for c in ("clean_text", "evidence_excerpt") if c[:5] == {"crawl": "clean", "canon": "evide"}.get(f.rsplit("/", 1)[1][:5]))]
    whole = "\n".join(t for s in texts for t in s)
    seeds = [s for line in residue.NOTICES + residue.FILLER for s in re.split(r"(?<=[.!?])\s+", line) if len(s) > 8] + [s for s in residue.SLOTS if "{" in s or "<" in s]
    assert not [s for s in seeds if s in whole]
