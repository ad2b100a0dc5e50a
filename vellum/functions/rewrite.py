"""Functions of one text that have a state or need more than the engine's built-in functions; operators apply them to Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache


def expand(template: str, match: re.Match[str]) -> str:
    r"""A replacement template: \1..\9 and \0 groups, \n and \t, and \L \U \T \S ... \E for small, capital, title and sentence case. Unknown escapes are the character itself."""
    out: list[str] = []
    case, start, at = "", 0, 0

    def close() -> None:
        piece = "".join(out[start:])
        change = {"L": str.lower, "U": str.upper, "T": title_case, "S": lambda x: x[:1].upper() + x[1:].lower()}.get(case)
        if change:
            out[start:] = [change(piece)]

    while at < len(template):
        c = template[at]
        if c != "\\" or at + 1 == len(template):
            out.append(c)
            at += 1
            continue
        c = template[at + 1]
        at += 2
        if c.isdigit():
            out.append(match.group(int(c)) or "" if int(c) <= match.re.groups else "")
        elif c in "LUTS":
            close()
            case, start = c, len(out)
        elif c == "E":
            close()
            case, start = "", len(out)
        else:
            out.append({"n": "\n", "t": "\t"}.get(c, c))
    close()
    return "".join(out)


def replace_all(pattern: str, template: str, text: str) -> str:
    return re.sub(pattern, lambda m: expand(template, m), text)


#: Words that stay small in titles.
SMALL_WORDS = frozenset("a an and at by from in of on the to".split())


def title_case(text: str) -> str:
    words = text.lower().split(" ")
    return " ".join(w if i and w in SMALL_WORDS else w[:1].upper() + w[1:] for i, w in enumerate(words))


def normalised(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def unaccented(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def character_name(c: str) -> str:
    return unicodedata.name(c, f"U+{ord(c):04X}")


@lru_cache(1)
def _names() -> list[tuple[str, frozenset[str]]]:
    return [(chr(i), frozenset(re.split("[ -]", unicodedata.name(chr(i), "")))) for i in range(32, 0x2FFFF) if unicodedata.name(chr(i), "")]


def characters_named(words: str) -> list[str]:
    """Characters whose names have all the words; a hexadecimal number or a single character stands for itself."""
    if len(words) == 1:
        return [words]
    if re.fullmatch("(?:U[+])?[0-9A-Fa-f]{4,5}", words):
        return [chr(int(words.removeprefix("U+"), 16))]
    wanted = set(words.upper().split())
    return [c for c, name in _names() if wanted <= name]


#: Words that begin with an apostrophe.
APOSTROPHES = frozenset("tis twas twere twould twill em til cause bout round neath gainst mid mongst tween".split())


def curly_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """Straight quotes made curly, paragraph by paragraph, and what is odd: (place, why). Double quotes alternate in a paragraph; a paragraph may end with one open when the next begins with a quote. Ditto marks stay."""
    out, odd, at = [], [], 0
    paragraphs = re.split(r"(\n(?:[ \t]*\n)+)", text)
    for i, part in enumerate(paragraphs):
        if i % 2 or not part:
            out.append(part)
            at += len(part)
            continue
        is_open, made = False, []
        for k, c in enumerate(part):
            before, after = part[k - 1 : k] if k else "", part[k + 1 : k + 2]
            if c == '"':
                if (not before or before in " \n") and (not after or after in " \n"):
                    made.append(c)
                    odd.append((at + k, "floating quote"))
                    continue
                is_open = not is_open
                made.append("“" if is_open else "”")
                if is_open and after in (" ", "\n", ""):
                    odd.append((at + k, "opening quote before a space"))
                if not is_open and before in (" ", "\n", ""):
                    odd.append((at + k, "closing quote behind a space"))
            elif c == "'":
                word = re.match("[a-z]+", part[k + 1 : k + 12].lower())
                inner = before.isalnum()
                made.append("’" if inner or not after.strip() or (word and word[0] in APOSTROPHES) or after.isdigit() else "‘")
            else:
                made.append(c)
        if is_open and not (i + 2 < len(paragraphs) and paragraphs[i + 2][:1] == '"'):
            odd.append((at + len(part), "quote not closed"))
        out.append("".join(made))
        at += len(part)
    return "".join(out), odd


def filled(words: list[str], width: int, first: int = 0, rest: int = 0) -> list[str]:
    """Lines of words with the least sum of squared differences from one under the width; the last line costs nothing unless it is too long. A word that is longer than a line has it for itself."""
    n, goal = len(words), width - 1
    best: list[tuple[int, int]] = [(0, 0)] * (n + 1)
    for i in range(n - 1, -1, -1):
        size, found = (first if i == 0 else rest) - 1, None
        for j in range(i, n):
            size += len(words[j]) + 1
            if size > width and j > i:
                break
            cost = (0 if j == n - 1 and size <= width else (goal - size) ** 2) + best[j + 1][0]
            if found is None or cost < found[0]:
                found = (cost, j + 1)
        best[i] = found
    out, i = [], 0
    while i < n:
        j = best[i][1]
        out.append(" " * (first if i == 0 else rest) + " ".join(words[i:j]))
        i = j
    return out


#: Block marks and what they do: fill with a margin, leave, shift, fill each line, centre, align right.
_OPEN, _CLOSE = re.compile(r"^/([#$*PLFXICR])(?:\[(\d*)(?:\.(\d+))?(?:,(\d+))?\])?$", re.I), re.compile(r"^([#$*PLFXICR])/$", re.I)


class BlockError(ValueError):
    pass


def rewrapped(text: str, width: int = 72, step: int = 2) -> str:
    """Paragraphs filled anew. In /# #/ margins grow (or are as given), in /$ and /x and /f lines stay, in /* /p /l they keep their shape and are moved to the margin, in /i each is an entry, in /c they are centred, in /r on the right. Blocks nest only in /#."""
    out: list[str] = []
    para: list[str] = []
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, width)]
    held: list[str] = []

    def flush() -> None:
        if para:
            _, left, first, right = stack[-1]
            out.extend(filled(" ".join(para).split(), max(8, right), first, left))
            para.clear()

    def block(kind: str, lines: list[str], left: int, right: int) -> None:
        least = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
        for x in lines:
            if not x.strip():
                out.append("")
            elif kind in "$XF":
                out.append(x)
            elif kind == "C":
                out.append(x.strip().center(right).rstrip())
            elif kind == "R":
                out.append(x.strip().rjust(right))
            elif kind == "I":
                indent = len(x) - len(x.lstrip()) - least
                out.extend(filled(x.split(), right, left + indent, left + indent + 4))
            else:
                out.append(" " * (left + (4 if kind != "L" else 0)) + x[least:])

    for number, line in enumerate(text.split("\n"), 1):
        kind = stack[-1][0]
        if m := _CLOSE.match(line):
            flush()
            if kind != m[1].upper():
                raise BlockError(f"line {number}: {line} closes nothing")
            _, left, _, right = stack.pop()
            if kind != "#":
                block(kind, held, stack[-1][1], stack[-1][3])
                held.clear()
        elif (m := _OPEN.match(line)) and kind in ("", "#"):
            flush()
            _, left, _, right = stack[-1]
            new = int(m[2]) if m[2] else left + step
            stack.append((m[1].upper(), new, int(m[3]) if m[3] else new, int(m[4]) if m[4] else right))
        elif kind not in ("", "#"):
            held.append(line)
        elif not line.strip():
            flush()
            out.append("")
        else:
            para.append(line)
    if len(stack) > 1:
        raise BlockError(f"/{stack[-1][0]} is not closed")
    flush()
    return "\n".join(out)


def aligned(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """(equal, replace, delete or insert; range in a; range in b) that make b of a."""
    return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def tokens_with_lines(text: str) -> list[tuple[str, int]]:
    return [(w, i) for i, line in enumerate(text.split("\n"), 1) for w in line.split()]


def differences(a: str, b: str, fold: bool = False) -> list[tuple[str, int, str, int]]:
    """(words of a, their first line, words of b, their first line) for each change; common beginnings and ends of a changed pair are left out."""
    left, right = tokens_with_lines(a), tokens_with_lines(b)
    words = lambda x: [w.lower() if fold else w for w, _ in x]
    out = []
    for kind, a1, a2, b1, b2 in aligned(words(left), words(right)):
        if kind == "equal":
            continue
        x, y = " ".join(w for w, _ in left[a1:a2]), " ".join(w for w, _ in right[b1:b2])
        n = common_prefix(x, y)
        m = common_suffix(x[n:], y[n:])
        out.append((x[n : len(x) - m], left[min(a1, len(left) - 1)][1] if left else 0, y[n : len(y) - m], right[min(b1, len(right) - 1)][1] if right else 0))
    return out


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def common_suffix(a: str, b: str) -> int:
    return common_prefix(a[::-1], b[::-1])


def marked_difference(a: str, b: str) -> str:
    """a with [-taken-] and [+put+] words, line ends as spaces."""
    left, right, out = a.split(), b.split(), []
    for kind, a1, a2, b1, b2 in aligned(left, right):
        if kind == "equal":
            out.append(" ".join(left[a1:a2]))
        else:
            out += [f"[-{' '.join(left[a1:a2])}-]"] * (a2 > a1) + [f"[+{' '.join(right[b1:b2])}+]"] * (b2 > b1)
    return " ".join(x for x in out if x)


def to_html(text: str, title: str = "") -> str:
    """A text as a page: blocks by their marks, headings by blank lines before them (four: a chapter, two: a section), paragraphs by blank lines; inline markup by name; page separators as anchors."""
    body: list[str] = []
    para: list[str] = []
    blanks, heading, block, chapters = 4, "", "", 0
    escape = lambda x: re.sub(r"&lt;(/?(?:i|b|sc|f|g|em|strong|sup|sub))&gt;", r"<\1>", x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("--", "—"))
    inline = lambda x: re.sub(r"<(/?)i>", r"<\1em>", re.sub(r"<sc>(.*?)</sc>", r'<span class="smcap">\1</span>', x))

    def flush() -> None:
        nonlocal heading, chapters
        if para:
            content = inline(escape("\n".join(para)))
            if heading:
                if heading == "h2":
                    if chapters:
                        body.append("</div>")
                    body.append('<div class="chapter">')
                    chapters += 1
                body.append(f"<{heading}>{content}</{heading}>")
            else:
                body.append(f"<p>{content}</p>")
            para.clear()
        heading = ""

    for line in text.split("\n"):
        if m := re.match(r"-----File: ?([^.-]+)", line):
            body.append(f'<span class="pagenum" id="Page_{m[1]}"></span>') if not para else para.append(f"\x00{m[1]}\x00")
            continue
        if m := _OPEN.match(line):
            flush()
            block = m[1].upper()
            body.append({"#": "<blockquote>", "*": '<div class="nowrap">', "$": "<pre>", "P": '<div class="poetry">', "L": "<ul>"}.get(block, f'<div class="block{block.lower()}">'))
            continue
        if m := _CLOSE.match(line):
            flush()
            body.append({"#": "</blockquote>", "$": "</pre>", "L": "</ul>"}.get(m[1].upper(), "</div>"))
            block = ""
            continue
        if block and block != "#":
            indent = len(line) - len(line.lstrip())
            body.append(escape(line) if block == "$" else f"<li>{escape(line.strip())}</li>" if block == "L" and line.strip() else f'<div class="verse indent{indent}">{inline(escape(line.strip()))}</div>' if line.strip() else "")
            continue
        if not line.strip():
            flush()
            blanks += 1
            continue
        if not para and blanks >= 4:
            heading = "h2" if body or chapters else "h1"
        elif not para and blanks >= 2:
            heading = "h3"
        blanks = 0
        para.append(line.strip())
    flush()
    if chapters:
        body.append("</div>")
    page = re.sub("\x00([^\x00]*)\x00", r'<span class="pagenum" id="Page_\1"></span>', "\n".join(x for x in body if x))
    return f"<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body>\n{page}\n</body></html>"


def stepped_to_grid(lines: list[str]) -> list[list[str]]:
    """A table in steps (each column further right, a bar before it) as rows of cells; a blank line ends a row."""
    rows, cells = [], []
    for line in [*lines, ""]:
        if not line.strip():
            if cells:
                rows.append([" ".join(c).strip() for c in cells])
            cells = []
            continue
        depth = line.count("|")
        while len(cells) <= depth:
            cells.append([])
        cells[depth].append(line.rsplit("|", 1)[-1].strip())
    return rows


def grid_to_stepped(rows: list[list[str]], step: int = 4) -> list[str]:
    return [x for row in rows for x in [*((" " * (step - 1) + "|") * k + cell for k, cell in enumerate(row)), ""]]


def adjusted_column(rows: list[list[str]], column: int, width: int) -> list[list[str]]:
    """Rows with one column filled to a width; a row whose cell has become several lines becomes several rows."""
    out = []
    for row in rows:
        parts = filled(row[column].split(), width) if column < len(row) and row[column].strip() else [row[column] if column < len(row) else ""]
        for i, part in enumerate(parts):
            out.append([part.ljust(width) if k == column else (cell if not i else " " * len(cell)) for k, cell in enumerate(row)])
    return out


def with_css(page: str, css: dict[str, dict[str, str]]) -> str:
    """A page's text under a few CSS rules for classes: display: none, text-transform, and content put before or behind."""
    for name, rules in css.items():
        def apply(m: re.Match[str], rules=rules) -> str:
            inner = m[3]
            if rules.get("display") == "none":
                return ""
            inner = {"uppercase": str.upper, "lowercase": str.lower, "capitalize": str.title}.get(rules.get("text-transform", ""), str)(inner)
            return m[1] + rules.get("before", "") + inner + rules.get("after", "") + m[4]

        page = re.sub(rf"(<(\w+)[^<>]* class=[\"']?{re.escape(name)}[\"']?[^<>]*>)([^<]*)(</\2>)", apply, page)
    return page


#: Languages whose guillemets point inwards.
INWARD = frozenset("de hr cs da hu pl sr sk sl sv".split())
#: Signs by where no space may stand: before them, behind them, or on neither side.
CLOSERS = {"!": "space before !", "?": "space before ?", ",": "space before comma", ":": "space before colon", ";": "space before semicolon", **dict.fromkeys(")]}", "space and close bracket"), "”": "space and close quote"}
OPENERS = {**dict.fromkeys("([{", "open bracket and space"), **dict.fromkeys("“‘", "open quote and space")}
#: Blocks whose lines stay as they are.
KEPT_BLOCKS = frozenset("$*XF")
Finding = tuple[int, int, str, str]


def _gaps(line: str, language: str) -> Iterator[Finding]:
    """(start, end, kind, new text) of each run of spaces inside a line that shouldn't be there or be shorter, judged by the signs on both sides."""
    turned = language in INWARD
    closers, openers = {**CLOSERS, "«" if turned else "»": "guillemet and space"}, {**OPENERS, "»" if turned else "«": "guillemet and space"}
    for m in re.finditer(" +", line):
        start, end = m.span()
        before, after = line[:start], line[end:]
        if not after:
            yield start, end, "spaces at the end", ""
        elif not before:
            continue
        elif after[0] in closers:
            yield start, end, closers[after[0]], ""
        elif before[-1] in openers:
            yield start, end, openers[before[-1]], ""
        elif before == '"':
            yield start, end, "open quote and space", ""
        elif after == '"':
            yield start, end, "space and close quote", ""
        elif after[0] == "." and (len(after) == 1 or not (after[1] == "." or after[1].isdigit())):
            yield start, end, "spaced full stop", ""
        elif (before[-1] == "-" and before[-2:] != "--") or (after[0] == "-" and after[:2] != "--"):
            yield start, end, "spaced hyphen", ""
        elif end - start > 1:
            yield start, end, "multiple spaces", " "


def _line_fixes(line: str, language: str) -> list[Finding]:
    """All that the basic fix-up would change in one line, by place. A row of asterisks is taken as a whole, as its spaces have a meaning."""
    if set(line) <= {"*", " "} and "*" in line:
        signs, thought = line.count("*"), "       *       *       *       *       *"
        return [(0, len(line), "asterisks", thought)] if signs > 3 and line != thought else []
    out = list(_gaps(line, language))
    for word in re.finditer(r"(?<![^\W_])l+(?=(?:st|th)(?![^\W_]))", line):
        if word[0] + line[word.end() : word.end() + 2] in ("lst", "llth"):
            out.append((*word.span(), "l for 1", "1" * len(word[0])))
    for dots in re.finditer(r"\.+", line):
        beside = line[max(0, dots.start() - 1) : dots.start()], line[dots.end() : dots.end() + 1]
        if len(dots[0]) == 3 and beside[0] and beside[0] not in "!? \"“‘" and (not beside[1] or beside[1] not in "!?"):
            out.append((*dots.span(), "dots", " ..."))
    return sorted(out)


def open_lines(text: str) -> Iterator[tuple[int, str]]:
    """Lines, by number, that a fix-up may change: without block markup and the blocks that stay, a poem's without the number at the end."""
    block = ""
    for number, line in enumerate(text.split("\n"), 1):
        if not block and (m := _OPEN.match(line)):
            block = m[1].upper() if m[1].upper() in KEPT_BLOCKS | set("PL") else ""
        elif block and (m := _CLOSE.match(line)) and m[1].upper() == block:
            block = ""
        elif block not in KEPT_BLOCKS or not block:
            yield number, line.rstrip().rstrip("0123456789").rstrip() if block == "P" and re.search(r"\s\s\d+\s*$", line) else line


def fixup_findings(text: str, language: str = "en") -> list[tuple[int, str, int, int]]:
    """(line, kind, start, end) of what the basic fix-up would change."""
    return [(number, kind, start, end) for number, line in open_lines(text) for start, end, kind, _ in _line_fixes(line, language)]


def fixed_up(line: str, language: str = "en") -> str:
    """A line after all fix-ups."""
    return edited(line, [(start, end, new) for start, end, _, new in _line_fixes(line, language)])


def joined_pages(text: str, keep: frozenset[str] = frozenset()) -> str:
    """A text without page separators: a hyphen at a page's end joins the word (and stays where the joined word is in keep), a dash joins without space, blank lines behind the separator stay as a break, other pages are joined as lines."""
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        if not lines[i].startswith("-----File:"):
            out.append(lines[i])
            i += 1
            continue
        while i < len(lines) and lines[i].startswith("-----File:"):
            i += 1
        blanks = 0
        while i + blanks < len(lines) and not lines[i + blanks].strip():
            blanks += 1
        while out and not out[-1].strip():
            out.pop()
        if not out or i + blanks == len(lines):
            i += blanks
            continue
        if blanks:
            out += [""] * (4 if blanks >= 4 else 2 if blanks >= 2 else 1)
            i += blanks
            continue
        last, first, _, rest = out[-1].rstrip("*"), *lines[i].lstrip("*").partition(" ")
        if last.endswith(("--", "—")):
            out[-1] = last + first
        elif last.endswith("-"):
            stem = last.rsplit(" ", 1)[-1][:-1]
            out[-1] = (last if f"{stem}-{first}" in keep else last[:-1]) + first
        else:
            i += 0
            continue
        lines[i] = rest
        if not rest:
            i += 1
    return "\n".join(out)


#: The footnotes' start, and the line under which moved footnotes stand.
FOOTNOTE, LANDING = re.compile(r"\[ *footnote *([^:\]\n]*):? ?", re.I), "FOOTNOTES:"


def footnotes(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, place of its anchor or -1) of each footnote: the end is the bracket that closes it over one nested level, else the line's end; the anchor is the nearest [label] above that no block mark or backslash precedes."""
    out = []
    for m in FOOTNOTE.finditer(text):
        depth, end = 0, -1
        for k in range(m.start(), len(text)):
            depth += (text[k] == "[") - (text[k] == "]")
            if depth > 2:
                break
            if not depth:
                end = k + 1
                break
        if end < 0:
            end = text.find("\n", m.start())
            end = len(text) if end < 0 else end
        label, anchor = m[1].strip(), -1
        if label:
            anchor = text.rfind(f"[{label}]", 0, m.start())
            while anchor >= 0 and re.search(r"(?:/[#$*FILPXCR]|\\)\Z", text[max(0, anchor - 2) : anchor]):
                anchor = text.rfind(f"[{label}]", 0, anchor)
        out.append((m.start(), end, label, anchor))
    return out


def footnotes_moved(text: str) -> str:
    """Footnotes under the next landing line below each, in their order, or under one at the end."""
    found = footnotes(text)
    if not found:
        return text
    zones = [m.end() for m in re.finditer(rf"^{LANDING}$", text, re.M)]
    notes: dict[int, list[str]] = {}
    for start, end, _, _ in found:
        notes.setdefault(next((z for z in zones if z >= end), -1), []).append(text[start:end])
    out, at = [], 0
    for place in sorted([*(f[0] for f in found), *zones]):
        here = next((f for f in found if f[0] == place), None)
        if here:
            out.append(text[at : here[0]])
            at = here[1]
        else:
            out.append(text[at:place] + "".join(f"\n\n{n}" for n in notes.get(place, [])))
            at = place
    out.append(text[at:])
    if notes.get(-1):
        out.append(f"\n\n{LANDING}" + "".join(f"\n\n{n}" for n in notes[-1]))
    return re.sub(r"\n{3,}", "\n\n", "".join(out))


def reindexed(text: str, style: str = "number") -> str:
    """Footnotes and their anchors with new labels in order: numbers, letters (A to Z, AA) or Roman numerals."""
    edits = []
    for i, (start, _, label, anchor) in enumerate(footnotes(text), 1):
        new = {"number": str(i), "letter": chr(65 + (i - 1) % 26) * ((i - 1) // 26 + 1), "roman": roman(i)}[style]
        m = FOOTNOTE.match(text, start)
        edits.append((start, m.end(), f"[Footnote {new}: "))
        if anchor >= 0:
            edits.append((anchor, anchor + len(label) + 2, f"[{new}]"))
    return edited(text, edits)


def roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += sign * (n // value)
        n %= value
    return out


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Edits (start, end, replacement) put in from right to left; of edits that overlap the leftmost counts."""
    kept: list[tuple[int, int, str]] = []
    for e in sorted(set(edits)):
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    for start, end, new in reversed(kept):
        text = text[:start] + new + text[end:]
    return text


def phrase_verdict(level: str, n: int, swapped: int, half_known: bool = False) -> bool:
    """Is a phrase suspect, seen n times, and swapped times with the partner word? level: tolerant, normal, paranoid."""
    if level == "tolerant":
        return n == 0 and swapped > 0
    if n == swapped == 0:
        return level == "paranoid" or not half_known
    return swapped > 0 and (n == 0 or swapped / n > 1)
