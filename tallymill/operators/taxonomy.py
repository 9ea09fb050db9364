"""Scored keyword taxonomy: most keywords found wins, the earlier entry wins a tie."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallymill.functions.marks import Marks, ask, linear
from tallymill.functions.text import any_of, array, first_of, has, lit, normalise_blanks, rx, when


@dataclass(frozen=True)
class Entry:
    """keywords: patterns over lower-cased text; ``\\b`` is the edge of an ASCII word."""

    type: str
    category: str
    sub_category: str | None
    keywords: tuple[str, ...]
    direction: str | None = None
    min_amount: float | None = None
    max_amount: float | None = None


# The taxonomy, in tie-break order.
TAXONOMY: list[Entry] = [
    Entry(
        "Expense", "Food & Dining", "Quick Commerce",
        (r"\bblinkit\b", r"\bzepto", r"\bswiggy\s+instamart\b", r"\binstamart\b", r"\bdunzo\b"),
    ),
    Entry(
        "Expense", "Food & Dining", "Restaurants",
        (r"\bzomato\b", r"\bswiggy\b", r"\brestaurant\b", r"\bpizza\s+hut\b", r"\bdominos?\b", r"\bkfc\b",
         r"\bmcdonald'?s?\b", r"\bsubway\b", r"\bburger\s+king\b", r"\bstarbucks\b", r"\bcafe\b", r"\bdining\b",
         r"\bcoffee\b", r"\bmeal\b"),
    ),
    Entry(
        "Expense", "Food & Dining", "Groceries",
        (r"\bbigbasket\b", r"\bd[\s-]?mart\b", r"\breliance\s+(fresh|smart)\b", r"\bsupermarket\b", r"\bgrocery\b",
         r"\bbig\s+bazaar\b"),
    ),
    Entry(
        "Expense", "Food & Dining", "Milk & Dairy",
        (r"\bmilk\b", r"\bdairy\b", r"\bmilk\s+booth\b"),
    ),
    Entry(
        "Expense", "Entertainment", "OTT Subscriptions",
        (r"\bnetflix\b", r"\bhotstar\b", r"\bdisney\+?\s*hotstar\b", r"\bamazon\s+prime\b", r"\bsonyliv\b",
         r"\bzee5\b"),
    ),
    Entry(
        "Expense", "Shopping", "Online Shopping",
        (r"\bamazon\b(?!\s+prime)", r"\bflipkart\b", r"\bmyntra\b", r"\bnykaa\b", r"\bmeesho\b"),
    ),
    Entry(
        "Expense", "Shopping", "Electronics",
        (r"\bcroma\b", r"\bvijay\s+sales\b", r"\breliance\s+digital\b"),
    ),
    Entry(
        "Expense", "Transportation", "Tolls & FASTag",
        (r"\bfastag\b", r"\bnhai\b", r"\btoll\s+(plaza|gate|debit|charge)\b"),
    ),
    Entry(
        "Expense", "Transportation", "Ride Hailing",
        (r"\buber\b", r"\bola\b", r"\brapido\b", r"\bblusmart\b"),
    ),
    Entry(
        "Expense", "Transportation", "Fuel",
        (r"\bpetrol\s+(pump|station|bunk)\b", r"\bhpcl\b", r"\biocl\b", r"\bbpcl\b"),
    ),
    Entry(
        "Expense", "Transportation", "Bus",
        (r"\bredbus\b", r"\babhibus\b", r"\bkeybus\b"),
    ),
    Entry(
        "Expense", "Transportation", "Public Transit",
        (r"\bmetro\s+(rail|card|recharge|fare)\b", r"\birctc\b", r"\bindian\s+railways?\b", r"\bautope\b"),
    ),
    Entry(
        "Expense", "Transportation", "Parking",
        (r"\bparking\b",),
    ),
    Entry(
        "Expense", "Transportation", "Vehicle Service & Repair",
        (r"\bmotors?\b", r"\bgarage\b", r"\bworkshop\b", r"\bcar\s+service\b", r"\bbike\s+service\b",
         r"\bauto\s*mobile\b"),
    ),
    Entry(
        "Expense", "Utilities", "Electricity",
        (r"\bescom\b", r"\bmseb\b", r"\bbescom\b", r"\btata\s+power\b", r"\bpower\s+(bill|payment)\b",
         r"\belectricity\s+(bill|payment)\b"),
    ),
    Entry(
        "Expense", "Utilities", "Gas",
        (r"\bgas\s+(bill|payment)\b", r"\bindane\b", r"\bbharat\s+gas\b", r"\bhp\s+gas\b"),
    ),
    Entry(
        "Expense", "Utilities", "Piped Gas",
        (r"\bpiped\s+gas\b", r"\bpng\s+bill\b", r"\bmahanagar\s+gas\b", r"\bindraprastha\s+gas\b"),
    ),
    Entry(
        "Expense", "Utilities", "Water",
        (r"\bwater\s+(bill|tax|tanker|board|supply|charge)\b", r"\bbwssb\b", r"\bhmwssb\b", r"\bjal\s+board\b"),
    ),
    Entry(
        "Expense", "Utilities", "DTH & Cable TV",
        (r"\btata\s*sky\b", r"\bd2h\b", r"\bdish\s*tv\b", r"\bsun\s+direct\b", r"\bdth\s+recharge\b",
         r"\bcable\s+tv\b"),
    ),
    Entry(
        "Expense", "Telecom", "Mobile Recharge",
        (r"\bjio\b(?!\s*(mart|saavn|cinema|hotstar|fiber))", r"\breliance\s+jio\b",
         r"\bairtel\b(?!\s*(xstream|payments\s*bank|thanks|fiber))", r"\bbharti\s+airtel\b",
         r"\bmobile\s+(recharge|topup)\b", r"\btalktime\b"),
    ),
    Entry(
        "Expense", "Utilities", "Broadband",
        (r"\bjio\s+fiber\b", r"\bairtel\s+fiber\b", r"\bact\s+fibernet\b", r"\bhathway\b", r"\bexcitel\b",
         r"\bbsnl\s+broadband\b", r"\bbroadband\s+(bill|payment)\b", r"\bwifi\s+(bill|recharge)\b",
         r"\binternet\s+(bill|recharge)\b"),
    ),
    Entry(
        "Expense", "Healthcare", "Pharmacy",
        (r"\bapollo\s+pharmacy\b", r"\bmedplus\b", r"\bnetmeds\b", r"\bpharmeasy\b", r"\b1mg\b", r"\bpharmacy\b",
         r"\bmedicals?\b"),
    ),
    Entry(
        "Expense", "Healthcare", "Hospital & Clinic",
        (r"\bhospital\b", r"\bclinic\b", r"\bfortis\b", r"\bapollo\s+hospitals?\b", r"\bconsultation\s+fee\b"),
    ),
    Entry(
        "Expense", "Entertainment", "Movies & Events",
        (r"\bbookmyshow\b", r"\bpvr", r"\binox\b", r"\bcinepolis\b"),
    ),
    Entry(
        "Expense", "Education", "Tuition & Courses",
        (r"\bbyju'?s?\b", r"\bunacademy\b", r"\budemy\b", r"\bschool\s+fee\b", r"\bcollege\s+fee\b",
         r"\btuition\s+fee\b"),
    ),
    Entry(
        "Expense", "Travel", "Flight",
        (r"\bindigo\b", r"\bair\s+india\b", r"\bspicejet\b", r"\bvistara\b", r"\bflight\s+ticket\b",
         r"\bcleartrip\b", r"\beasemytrip\b", r"\bixigo\b"),
    ),
    Entry(
        "Expense", "Travel", "Accommodation",
        (r"\boyorooms?\b", r"\btreebo\b", r"\bfabhotel\b", r"\bhotel\s+booking\b", r"\bgoibibo\b",
         r"\bbooking\.com\b", r"\bairbnb\b", r"\bmakemytrip\b"),
        min_amount=500,
    ),
    Entry(
        "Expense", "Travel", "General Travel",
        (r"\btravels?\b",),
    ),
    Entry(
        "Expense", "Rent & Housing", "House Rent",
        (r"\bhouse\s+rent\b", r"\bflat\s+rent\b", r"\brent\s+(payment|paid|transfer)\b", r"\bmonthly\s+rent\b"),
    ),
    Entry(
        "Expense", "Rent & Housing", "Maintenance & Society Charges",
        (r"\bmaintenance\s+(charge|fee|bill)\b", r"\bsociety\s+maintenance\b", r"\bapartment\s+maintenance\b",
         r"\bflat\s+maintenance\b", r"\brwa\s+(maintenance|charge|fee)\b"),
    ),
    Entry(
        "Expense", "Finance Charges", "Cash Withdrawal",
        (r"\batm\s+(debit|withdrawal|wdl|cash)\b", r"\bcash\s+withdrawal\b"),
    ),
    Entry(
        "Expense", "Finance Charges", "Bank Charges",
        (r"\bservice\s+charge\b", r"\bannual\s+(fee|charge)\b", r"\bpenalty\b", r"\blate\s+payment\s+fee\b"),
    ),
    Entry(
        "Expense", "Household", "Newspaper & Magazine",
        (r"\bnewspaper\b", r"\bmagazine\s+subscription\b", r"\bnews\s+agency\b"),
    ),
    Entry(
        "Expense", "Household", "Home Services",
        (r"\bpest\s+control\b", r"\bplumber\b", r"\belectrician\b", r"\bappliance\s+repair\b", r"\bro\s+service\b",
         r"\bwater\s+purifier\s+service\b", r"\burban\s*company\b"),
    ),
    Entry(
        "Expense", "Household", "Stationery",
        (r"\bstationers?\b", r"\bstationery\b"),
    ),
    Entry(
        "Expense", "Personal Care", None,
        (r"\bsalon\b", r"\bspa\b", r"\bparlour\b", r"\bbarber\b"),
    ),
    Entry(
        "Expense", "Fitness & Gym", None,
        (r"\bgym\b", r"\bfitness\b", r"\bcult\.?fit\b", r"\byoga\s+class\b"),
    ),
    Entry(
        "Expense", "Courier & Postal", None,
        (r"\bdtdc\b", r"\bblue\s*dart\b", r"\bindia\s+post\b", r"\bdelhivery\b", r"\bekart\b", r"\bxpressbees\b"),
    ),
    Entry(
        "Expense", "Taxes & Government", None,
        (r"\bincome\s+tax\b", r"\bgst\s+payment\b", r"\bproperty\s+tax\b", r"\bmunicipal\s+tax\b",
         r"\btraffic\s+challan\b", r"\be-?challan\b", r"\btds\b"),
    ),
    Entry(
        "Expense", "Subscriptions", None,
        (r"\bspotify\b", r"\byoutube\s+premium\b", r"\bapple\s+(music|one|icloud)\b", r"\bmicrosoft\s*365\b",
         r"\bgoogle\s+(one|workspace|storage)\b", r"\banthropic\b", r"\bclaude\b", r"\bopenai\b", r"\bchatgpt\b",
         r"\bcanva\b", r"\bdropbox\b", r"\bnotion\b", r"\baws\b"),
    ),
    Entry(
        "Income", "Salary", "Monthly Salary",
        (r"\bsalary\b", r"\bsal\s+credit\b", r"\bpayroll\b", r"\bach\s+(credit|cr)\b", r"\bcorporate\s+credit\b",
         r"\bneft\s+cr\b"),
        direction="credit",
    ),
    Entry(
        "Income", "Refunds", "Purchase Refund",
        (r"\brefund\b", r"\bcashback\b", r"\breversal\b", r"\bamount\s+reversed\b", r"\brefunded\b"),
    ),
    Entry(
        "Income", "Passive Income", "Interest Income",
        (r"\binterest\s+(credit|credited|received)\b", r"\bfd\s+interest\b", r"\bsavings\s+interest\b"),
        direction="credit",
    ),
    Entry(
        "Income", "Dividends", "Stock Dividend",
        (r"\bdividend\b",),
        direction="credit",
    ),
    Entry(
        "Investment", "Mutual Funds", "SIP",
        (r"\bsip\s+(of|installment|debit|debited|payment|contribution)\b", r"\bsystematic\s+investment\s+plan\b"),
    ),
    Entry(
        "Investment", "Stocks", "Equity Purchase",
        (r"\bzerodha\b", r"\bgroww\b", r"\bupstox\b", r"\bangelone\b", r"\bangel\s+one\b", r"\bdhan\b"),
    ),
    Entry(
        "Investment", "Gold", None,
        (r"\bsafegold\b", r"\bdigital\s+gold\b", r"\bpaytm\s+gold\b", r"\bsovereign\s+gold\s+bond\b",
         r"\bgold\s+bond\b"),
    ),
    Entry(
        "Investment", "Insurance", "Life Insurance",
        (r"\blic\s+(premium|policy)\b", r"\bterm\s+(plan|insurance)\b", r"\binsurance\s+premium\b",
         r"\bpolicy\s+premium\b", r"\bbajaj\s+allianz\b", r"\bshriram\s*life\b", r"\bshriramlife\b"),
    ),
    Entry(
        "Investment", "Insurance", "Health Insurance",
        (r"\bhealth\s+insurance\b", r"\bmediclaim\b", r"\bstar\s+health\b", r"\bmanipal\s*cigna\b",
         r"\bmanipalcigna\b"),
    ),
    Entry(
        "Investment", "Insurance", "Motor Insurance",
        (r"\bmotor\s+insurance\b", r"\bvehicle\s+insurance\b", r"\bcar\s+insurance\b", r"\bbike\s+insurance\b",
         r"\bicici\s+lombard\b", r"\bhdfc\s+ergo\b", r"\bbajaj\s+allianz\s+general\b"),
    ),
    Entry(
        "Liability", "EMI", "Loan EMI",
        (r"\bemi\s+(deducted|debited|paid)\b", r"\bloan\s+emi\b", r"\bnach\s+debit\b", r"\bauto\s+debit\s+emi\b"),
    ),
    Entry(
        "Liability", "Loans", "Home Loan",
        (r"\bhome\s+loan\b", r"\bhousing\s+loan\b", r"\bmortgage\b"),
    ),
    Entry(
        "Liability", "Loans", "Personal Loan",
        (r"\bpersonal\s+loan\b", r"\binstant\s+loan\b"),
    ),
    Entry(
        "Asset", "Bank Deposits", "Fixed Deposit",
        (r"\bfixed\s+deposit\b", r"\bfd\s+(created|booked|opened)\b"),
    ),
    Entry(
        "Asset", "Government Schemes", "NPS",
        (r"\bnps\b", r"\bnational\s+pension\s+(scheme|system)\b"),
    ),
    Entry(
        "Asset", "Government Schemes", "PPF/SSY",
        (r"\bppf\b", r"\bpublic\s+provident\s+fund\b", r"\bsukanya\s+samriddhi\b", r"\bssy\b"),
    ),
]

# Label of a clearing-house debit that no keyword explains.
MANDATE_LABEL = ("Liability", "Recurring Payment", "NACH Mandate")


def marked(keyword: str) -> str:
    """The pattern with start and end marks instead of word edges; keywords begin with an edge."""
    return r"\<" + keyword.removeprefix(r"\b").replace(r"\b", r"\>")


def keyword_anchor(keyword: str) -> str:
    """A substring every hit must contain: its longest fixed run of letters and digits."""
    fixed = re.sub(r"\([^)]*\)+|\[[^\]]*\]\??|\\.[*+?]?|.\?", " ", re.sub(r"\(\?!.*\)$", "", keyword))
    return max(re.findall(r"[a-z0-9]+", fixed), key=len)


def any_keyword(taxonomy: list[Entry]) -> str:
    """One pattern for "some keyword is present", branching on the first letter at each word start."""
    by_letter: dict[str, list[str]] = {}
    for entry in taxonomy:
        for keyword in entry.keywords:
            pattern = marked(keyword).removeprefix(r"\<")
            by_letter.setdefault(pattern[0], []).append(pattern[1:])
    branches = "|".join(f"{letter}(?:{'|'.join(rests)})" for letter, rests in sorted(by_letter.items()))
    return rf"\<(?:{branches})"


def keyword_start(keyword: str) -> str:
    """The first two letters or digits of every hit, or the first alone where the second can vary."""
    body = keyword.removeprefix(r"\b")
    return body[:2] if re.match(r"[a-z0-9]{2}(?![?*+{|])", body) else body[0]


def families(taxonomy: list[Entry]) -> dict[str, str]:
    """What a text must hold for any entry; see ``functions/marks``."""
    patterns = [linear(marked(keyword)) for entry in taxonomy for keyword in entry.keywords]
    return {} if None in patterns else {"keyword": "|".join(patterns)}


def possible_entries(low: str, taxonomy: list[Entry]) -> str:
    """Positions (from 1) of all entries that can have a keyword in the text, and of few others. Wherever a word starts at which some
    keyword is found, its first letters are taken, which name the entries. Those letters hold no start of another word."""
    places: dict[str, list[int]] = {}
    for position, entry in enumerate(taxonomy, start=1):
        for start in dict.fromkeys(map(keyword_start, entry.keywords)):
            places.setdefault(start, []).append(position)
    of_start = "map(" + ", ".join(f"{lit(start)}, {array(found)}" for start, found in sorted(places.items())) + ")"
    pattern = rx(any_keyword(taxonomy).replace("(?:", "(?=(?:", 1) + ")[a-z0-9][a-z0-9]?", "")
    looked = [f"coalesce(try_element_at({of_start}, {key}), array())" for key in ("s", "left(s, 1)")]
    return f"flatten(transform(regexp_extract_all({low}, {lit(pattern)}, 0), s -> concat({', '.join(looked)})))"


def _score(entry: Entry, low: str) -> str:
    """Number of the entry's keywords found; no pattern runs unless one of the anchors is present."""
    hits = ", ".join(has(low, marked(k), "") for k in entry.keywords)
    anchors = list(dict.fromkeys(keyword_anchor(k) for k in entry.keywords))
    return when(any_of(low, anchors), f"size(filter(array({hits}), hit -> hit))", "0")


def best_entry(low: str, is_credit: str, amount: str, taxonomy: list[Entry] = TAXONOMY, possible: str | None = None) -> str:
    """Position (from 1) of the winning entry, 0 for none. Score and position share one integer. Only entries that can have a
    keyword are scored; ``possible`` is a column that names them, if there is one."""
    if possible is None:
        best = best_entry(low, is_credit, amount, taxonomy, "possible")
        return f"get(transform(array({possible_entries(low, taxonomy)}), possible -> {best}), 0)"
    size = len(taxonomy) + 1
    ranks = []
    for position, entry in enumerate(taxonomy, start=1):
        blocked = []
        if entry.direction:
            blocked.append((f"NOT {is_credit}" if entry.direction == "credit" else is_credit, "0"))
        if entry.min_amount is not None:
            blocked.append((f"{amount} < {entry.min_amount}", "0"))
        if entry.max_amount is not None:
            blocked.append((f"{amount} > {entry.max_amount}", "0"))
        blocked.insert(0, (f"NOT array_contains({possible}, {position})", "0"))
        ranks.append(f"{first_of(blocked, _score(entry, low))} * {size} - {position}")
    # a positive rank is score * size - position, so the position comes back as its negative remainder
    best = f"pmod(-greatest(0, {', '.join(ranks)}), {size})"
    return when(f"size({possible}) > 0", best, "0")


def with_labels(
    rows: DataFrame,
    eligible: str,
    low: str,
    is_credit: str,
    amount: str,
    channel: str,
    taxonomy: list[Entry] = TAXONOMY,
    marks: Marks | None = None,
) -> DataFrame:
    """Add ``type``, ``category``, ``sub_category`` and the guessed-mandate flag to eligible rows."""
    possible = when(ask(marks, "keyword", "true"), possible_entries(low, taxonomy), "array()")
    found = rows.selectExpr("*", f"{when(eligible, possible)} AS _possible")
    ranked = found.selectExpr("*", f"{when(eligible, best_entry(low, is_credit, amount, taxonomy, '_possible'))} AS _entry")
    guess = f"(_entry = 0 AND NOT {is_credit} AND coalesce({channel} = 'NACH', false))"

    def label(values: list[str | None], fallback: str) -> str:
        return first_of([("_entry > 0", f"get({array(values)}, _entry - 1)"), (guess, lit(fallback))])

    return ranked.selectExpr(
        *rows.columns,
        f"{label([e.type for e in taxonomy], MANDATE_LABEL[0])} AS type",
        f"{label([e.category for e in taxonomy], MANDATE_LABEL[1])} AS category",
        f"{label([e.sub_category for e in taxonomy], MANDATE_LABEL[2])} AS sub_category",
        f"coalesce({guess}, false) AS _mandate_guess",
    )


def classify(rows: DataFrame, taxonomy: list[Entry] = TAXONOMY) -> DataFrame:
    """Label rows that carry ``body``, ``direction``, ``amount`` (unsigned) and ``channel``."""
    staged = rows.selectExpr("*", f"lower({normalise_blanks('body')}) AS _low")
    known = "amount IS NOT NULL AND direction IS NOT NULL"
    labelled = with_labels(staged, known, "_low", "(direction = 'credit')", "amount", "channel", taxonomy)
    return labelled.drop("_low", "_mandate_guess")


def suggested_labels(suggested: str) -> str:
    """``type:category:sub`` text to a label struct; null when it has fewer than two parts."""
    parts = f"split({suggested}, ':')"
    labels = ", ".join(
        f"'{name}', get({parts}, {i})" for i, name in enumerate(["type", "category", "sub_category"])
    )
    return f"CASE WHEN size({parts}) >= 2 THEN named_struct({labels}) END"
