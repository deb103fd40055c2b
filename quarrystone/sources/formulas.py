"""Office formulas (OMML) as LaTeX."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

# The LaTeX commands of operators, brackets and accents.
OPERATORS = {"∑": r"\sum", "∏": r"\prod", "∐": r"\coprod", "∫": r"\int", "∮": r"\oint", "⋂": r"\bigcap", "⋃": r"\bigcup"}
BRACKETS = {"{": r"\{", "}": r"\}", "⟨": r"\langle", "⟩": r"\rangle", "⌊": r"\lfloor", "⌋": r"\rfloor", "⌈": r"\lceil", "⌉": r"\rceil"}
ACCENTS = {"̂": r"\hat", "^": r"\hat", "̄": r"\bar", "¯": r"\bar", "→": r"\vec", "⃗": r"\vec", "˙": r"\dot", "¨": r"\ddot", "̃": r"\tilde"}

Node = ElementTree.Element


def name(node: Node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def child(node: Node, wanted: str) -> Node | None:
    return next((c for c in node if name(c) == wanted), None)


def part(node: Node, wanted: str) -> str:
    """The LaTeX of a named part, empty where there is none."""
    found = child(node, wanted)
    return "" if found is None else inside(found)


def setting(node: Node, group: str, wanted: str) -> str | None:
    """A property's value: its attribute, else its text; None without the property."""
    properties = child(node, group)
    found = None if properties is None else child(properties, wanted)
    if found is None:
        return None
    return next((v for k, v in found.attrib.items() if k.rpartition("}")[2] == "val" and v), None) or found.text or ""


def scripts(base: str, sub: str = "", sup: str = "") -> str:
    return (f"{{{base}}}" if base else "") + (f"_{{{sub}}}" if sub else "") + (f"^{{{sup}}}" if sup else "")


def fraction(node: Node) -> str:
    over, under = part(node, "num"), part(node, "den")
    return rf"\frac{{{over}}}{{{under}}}" if over or under else ""


def root(node: Node) -> str:
    degree = part(node, "deg")
    return rf"\sqrt{f'[{degree}]' if degree else ''}{{{part(node, 'e')}}}"


def summed(node: Node) -> str:
    sign = setting(node, "naryPr", "chr") or ""
    body = part(node, "e")
    return OPERATORS.get(sign, sign or r"\sum") + scripts("", part(node, "sub"), part(node, "sup")) + (f" {body}" if body else "")


def bracketed(node: Node) -> str:
    """Parts of a delimiter stand between its signs, one separator between two of them."""
    left, right = (BRACKETS.get(x, x) for x in (setting(node, "dPr", "begChr") or "(", setting(node, "dPr", "endChr") or ")"))
    bodies = [inside(c) for c in node if name(c) == "e"]
    return rf"\left{left}{(setting(node, 'dPr', 'sepChr') or ' ').join(bodies)}\right{right}"


def accented(node: Node) -> str:
    command, body = ACCENTS.get(setting(node, "accPr", "chr") or ""), part(node, "e")
    return f"{command}{{{body}}}" if command else body


def table(node: Node) -> str:
    """Rows of a matrix or an equation array."""
    matrix = name(node) == "m"
    rows = [" & ".join(inside(c) for c in row if name(c) == "e") for row in node if name(row) == "mr"] if matrix else [inside(c) for c in node if name(c) == "e"]
    kind = "matrix" if matrix else "aligned"
    return rf"\begin{{{kind}}}" + r" \\ ".join(rows) + rf"\end{{{kind}}}"


RULES: dict[str, Callable[[Node], str]] = {
    "t": lambda n: (n.text or "").strip(),
    "f": fraction,
    "sSup": lambda n: scripts(part(n, "e"), sup=part(n, "sup")),
    "sSub": lambda n: scripts(part(n, "e"), part(n, "sub")),
    "sSubSup": lambda n: scripts(part(n, "e"), part(n, "sub"), part(n, "sup")),
    "sPre": lambda n: scripts("", part(n, "sub"), part(n, "sup")) + part(n, "e"),
    "limLow": lambda n: scripts(part(n, "e"), part(n, "lim")),
    "limUpp": lambda n: scripts(part(n, "e"), sup=part(n, "lim")),
    "rad": root,
    "nary": summed,
    "d": bracketed,
    "func": lambda n: part(n, "fName") + part(n, "e"),
    "acc": accented,
    "m": table,
    "eqArr": table,
}


def inside(node: Node) -> str:
    """The LaTeX of all that stands in a node, but for its properties."""
    kept = [node.text or ""]
    for c in node:
        if not name(c).endswith("Pr"):
            kept += [latex(c), c.tail or ""]
    return "".join(t for t in kept if t.strip()).strip()


def latex(node: Node) -> str:
    """The LaTeX of a node; of one without a rule, what stands in it."""
    return RULES.get(name(node), inside)(node)


def formula(node: Node) -> str:
    """A formula in its marks: those of a paragraph of their own are display formulas, a line each."""
    if name(node) == "oMathPara":
        whole = [inside(c) for c in node if name(c) == "oMath"]
        if any(whole):
            return "\n".join(f"$${t}$$" for t in whole if t)
    text = inside(node)
    return f"${text}$" if text else ""


def with_latex(rows: DataFrame, xml_col: str, out_col: str = "latex") -> DataFrame:
    """The rows with the LaTeX of their formula (``m:oMath`` or ``m:oMathPara`` as XML); null where it is null or no XML.

    An own column of that name gives way. Unknown elements stand for what is in them.
    """
    rows = rows.drop(out_col)
    at = rows.columns.index(xml_col)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for text in batch.column(at).to_pylist():
                try:
                    out.append(None if text is None else formula(ElementTree.fromstring(text)))
                except ElementTree.ParseError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, out_col])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(convert, f"{kinds}, `{out_col}` string")
