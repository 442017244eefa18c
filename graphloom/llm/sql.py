"""Plain SQL for the text queries, where it can express them.

The consistent form is written there with DuckDB's own string functions, from a table of its own that
shares nothing with the operator's: Python's compatibility normalisation for single characters,
Unicode's class of format characters, and letters and signs listed here by script. Token ids,
alignment scores and hashed class ids have no SQL; tests hold them against plain loops.
"""

from __future__ import annotations

import unicodedata as ud

# Letters of other scripts and signs, each beside the characters of ASCII they look like, in order.
SCRIPTS = [
    ("асеіјорѕхуһԁԛԝӏѵг", "aceijopsxyhdqwlvr"),
    ("АВСЕНІЈКМОРЅТХҮԌԚԜѴӀЬ", "ABCEHIJKMOPSTXYGQWVIb"),
    ("αορυνιγϲϳ", "aopuviycj"),
    ("ΑΒΕΗΙΚΜΝΟΡΤΧΥΖϹͿϜ", "ABEHIKMNOPTXYZCJF"),
    ("ոօսհզաՕՏՍց", "nouhqwOSUg"),
    ("ɑɡıμ", "agiµ"),
    ("‐‑‒–−˗⁃", "-------"),
    ("’‘ʼ′ʹ´", "''''''"),
    ("“”″‚∶։∕⁄∗∣∼‹›‧∙⋅―─", '""",::' + "//*|~<>···——"),
]
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "...", "‥": "..", "ĳ": "ij", "Ĳ": "IJ", "ǉ": "lj", "ǌ": "nj"}
APART = "ſϱϐϑϕϖϰϴϵ"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pairs() -> dict[str, str]:
    """Character -> what stands for it, over all code points."""
    out = {chr(cp): " " for cp in range(0x80, 0x3001) if ud.category(chr(cp)) == "Zs"}
    for a, b in SCRIPTS:
        out |= {x: y for x, y in zip(a, b, strict=True) if x != y}
    for cp in range(0x80, 0x20000):
        ch = chr(cp)
        tag = ud.decomposition(ch).partition(" ")[0]
        if tag in ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>") and ch not in out and ch not in APART and len(to := ud.normalize("NFKC", ch)) == 1 and to != ch:
            out[ch] = out.get(to, to)
    return out


def form_sql(text: str) -> str:
    """An SQL expression for the consistent form of the expression ``text``."""
    p = pairs()
    hidden = r"[\p{Cf}\x{34f}\x{180b}-\x{180f}\x{fe00}-\x{fe0f}\x{e0100}-\x{e01ef}]"
    out = f"nfc_normalize(regexp_replace({text}, '{hidden}', '', 'g'))"
    for a, b in JOINED.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize(translate({out}, {_quoted(''.join(p))}, {_quoted(''.join(p.values()))}))"


def _words(table: str, key: str) -> str:
    twice = form_sql("lower(f)")
    return f"(select distinct {key}, w[i : i + 12] as g from (select {key}, w, unnest(range(1, len(w) - 11)) as i from (select {key}, regexp_extract_all({twice}, '[\\p{{L}}\\p{{N}}]+') as w from (select {key}, {form_sql('text')} as f from {table} where text <> ''))))"


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": f"select distinct d.doc_id, e.item_id from {_words('documents', 'doc_id')} d join {_words('eval_items', 'item_id')} e using (g)",
        "p8_found": f"with c as (select doc_id, text, {form_sql('text')} as f from documents where text <> '') select a.doc_id as doc_id_a, b.doc_id as doc_id_b from c a join c b on a.f = b.f and a.doc_id < b.doc_id and a.text <> b.text",
    }
