"""Expressions over assembly listings, one line at a time, by array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_match, lines, strip

# The instructions of the 65816 processor.
MNEMONICS = [
    "ADC", "AND", "ASL", "BCC", "BCS", "BEQ", "BIT", "BMI", "BNE", "BPL", "BRA", "BRK", "BRL", "BVC", "BVS", "CLC", "CLD", "CLI", "CLV", "CMP", "COP",
    "CPX", "CPY", "DEC", "DEX", "DEY", "EOR", "INC", "INX", "INY", "JML", "JMP", "JSL", "JSR", "LDA", "LDX", "LDY", "LSR", "MVN", "MVP", "NOP", "ORA",
    "PEA", "PEI", "PER", "PHA", "PHB", "PHD", "PHK", "PHP", "PHX", "PHY", "PLA", "PLB", "PLD", "PLP", "PLX", "PLY", "REP", "ROL", "ROR", "RTI", "RTL",
    "RTS", "SBC", "SEC", "SED", "SEI", "SEP", "STA", "STP", "STX", "STY", "STZ", "TAX", "TAY", "TCD", "TCS", "TDC", "TRB", "TSB", "TSC", "TSX", "TXA",
    "TXS", "TXY", "TYA", "TYX", "WAI", "WDM", "XBA", "XCE",
]
# Assembler directives that mark data.
DIRECTIVES = [
    "db", "dw", "dl", "dd", "incbin", "org", "base", "pad", "warnpc", "assert", "print", "printt", "incsrc", "include", "pushpc", "pullpc",
]
# Names of the console's hardware registers.
REGISTERS = [
    "INIDISP", "OBSEL", "OAMADDL", "OAMADDH", "OAMDATA", "BGMODE", "MOSAIC", "BG1SC", "BG2SC", "BG3SC", "BG4SC", "BG12NBA", "BG34NBA", "BG1HOFS",
    "BG1VOFS", "BG2HOFS", "BG2VOFS", "BG3HOFS", "BG3VOFS", "BG4HOFS", "BG4VOFS", "VMAIN", "VMADDL", "VMADDH", "VMDATAL", "VMDATAH", "M7SEL", "M7A",
    "M7B", "M7C", "M7D", "M7X", "M7Y", "CGADD", "CGDATA", "W12SEL", "W34SEL", "WOBJSEL", "WH0", "WH1", "WH2", "WH3", "WBGLOG", "WOBJLOG", "TM", "TS",
    "TMW", "TSW", "CGWSEL", "CGADSUB", "COLDATA", "SETINI", "APUIO0", "APUIO1", "APUIO2", "APUIO3", "MDMAEN", "HDMAEN", "MEMSEL", "NMITIMEN", "WRIO",
    "WRMPYA", "WRMPYB", "WRDIVL", "WRDIVH", "WRDIVB", "HTIMEL", "HTIMEH", "VTIMEL", "VTIMEH", "RDNMI", "TIMEUP", "HVBJOY", "RDIO", "RDDIVL", "RDDIVH",
    "RDMPYL", "RDMPYH", "JOY1L", "JOY1H", "JOY2L", "JOY2H", "JOY3L", "JOY3H", "JOY4L", "JOY4H",
]
# How operands show their addressing mode, for the semantic score. Operands are joined by line feeds, so
# blanks are spelled out; what follows a short address is matched and not looked ahead at, as SQL engines cannot.
MODES = {
    "immediate": r"#\$[0-9A-Fa-f]+|#\d+",
    "direct_page": r"\$[0-9A-Fa-f]{2}([^0-9A-Fa-f]|$)",
    "absolute": r"\$[0-9A-Fa-f]{4}([^0-9A-Fa-f]|$)",
    "long": r"\$[0-9A-Fa-f]{6}",
    "indexed_x": r",[ \t]*[Xx]",
    "indexed_y": r",[ \t]*[Yy]",
    "indirect": r"\([^)]+\)",
    "stack_relative": r"\$[0-9A-Fa-f]{2},[ \t]*[Ss]",
}


def code_of(line: Column) -> Column:
    """A line without its comment, stripped."""
    return strip(F.substring_index(line, ";", 1))


def code_lines(text: Column) -> Column:
    """The lines of a listing that hold code, comments cut."""
    return F.filter(F.transform(lines(text), code_of), lambda x: x != "")


def head(code: Column) -> Column:
    """The first word of a line, upper case, without a colon at its end."""
    return F.regexp_replace(F.upper(F.regexp_extract(code, r"^(\S+)", 1)), ":+$", "")


def operand(code: Column) -> Column:
    return strip(F.regexp_replace(code, r"^\S+", ""))


def is_mnemonic(word: Column) -> Column:
    return word.isin(MNEMONICS)


def instruction_heads(text: Column) -> Column:
    """First words, upper case, of the lines that read as instructions.

    What follows the last colon of a line counts; a line counts if its first word is a known
    instruction or begins with two letters or more.
    """
    after = F.transform(code_lines(text), lambda x: strip(F.substring_index(x, ":", -1)))
    words = F.transform(after, lambda x: F.upper(F.regexp_extract(x, r"^(\S+)", 1)))
    return F.filter(words, lambda w: w.isin(MNEMONICS) | w.rlike(r"^[A-Z]{2,4}"))


# Addressing modes by tests of an operand, in order of precedence.
ADDRESSING = [
    (r"^#(\$|.*#\$)[0-9A-Fa-f]{3,4}", "immediate_16"),
    (r"^#(\$|.*#\$)[0-9A-Fa-f]{1,2}", "immediate_8"),
    (r"^#", "immediate_symbol"),
    (r",\s*[Ss]", "stack_relative"),
    (r"(?i)^\([^)]+\).*,X|^\([^)]*,X[^)]*\)", "indexed_indirect_x"),
    (r"(?i)^\([^)]+\).*,Y|^\([^)]*,Y[^)]*\)", "indirect_indexed_y"),
    (r"^\([^)]+\)", "indirect"),
    (r",\s*[Xx]", "indexed_x"),
    (r",\s*[Yy]", "indexed_y"),
    (r"^\$[0-9A-Fa-f]{6}", "long"),
    (r"^\$[0-9A-Fa-f]{4}", "absolute"),
    (r"^\$[0-9A-Fa-f]{1,2}(\W|$)", "direct_page"),
    (r"^[Aa]$", "accumulator"),
    (r"^[A-Za-z_]\w*", "label"),
]


def addressing_mode(op: Column) -> Column:
    """The addressing mode of an operand, by the first test that holds; null for none and for an empty operand."""
    bare = strip(op)
    return first_match([(bare.rlike(pattern), mode) for pattern, mode in ADDRESSING], None)


def output_kind(text: Column) -> Column:
    """code if any line begins with an instruction, else data if any with a directive, else unknown."""
    body = F.filter(F.transform(lines(text), strip), lambda x: (x != "") & ~x.startswith(";"))
    bare = F.transform(body, lambda x: F.when(x.startswith("#_") & F.contains(x, F.lit(":")), strip(F.regexp_replace(x, "^[^:]*:", ""))).otherwise(x))
    bare = F.transform(bare, lambda x: F.when(x.rlike("^[A-Za-z0-9_]+:"), strip(F.regexp_replace(x, "^[^:]*:", ""))).otherwise(x))
    heads = F.transform(bare, lambda x: F.upper(F.regexp_extract(x, r"^(\S+)", 1)))
    return F.when(F.exists(heads, lambda w: w.isin(MNEMONICS)), "code").when(F.exists(heads, lambda w: F.lower(w).isin(DIRECTIVES)), "data").otherwise("unknown")


def first_label(text: Column) -> Column:
    """The first line of a listing that is nothing but a label, null if there is none."""
    found = F.filter(
        F.transform(lines(text), strip),
        lambda x: ~x.startswith(";") & ~x.startswith("#_") & x.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*[ \t]*::?[ \t]*\{?$"),
    )
    return F.regexp_extract(F.try_element_at(found, F.lit(1)), r"^([A-Za-z_][A-Za-z0-9_.]*)", 1)
