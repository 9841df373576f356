"""Languages, keyword lists, dead-code templates, task settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("c", "c_sharp", "go", "java", "javascript", "php", "python", "ruby")
CONFUSION_LANGUAGES = ("java", "c", "cpp", "c_sharp")

# Keyword lists used for token weights, one list per scored language. There is
# deliberately no list for go: its tokens all weigh as ordinary tokens.
KEYWORDS: dict[str, str] = {
    "c": """auto break case char const continue default do double else enum extern if elif else
        endif ifdef ifndef define undef include line error pragma defined __has_c_attribute float
        for goto if inline int long register restrict return short signed sizeof static struct
        switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex
        _Decimal128 _Decimal32 _Decimal64 _Generic _Imaginary _Noreturn _Static_assert
        _Thread_local""",
    "c_sharp": """abstract as base bool break byte case catch char checked class const continue
        decimal default delegate do double else enum event explicit extern false finally fixed
        float for foreach goto if implicit in int interface internal is lock long namespace new
        null object operator out override params private protected public readonly ref return
        sbyte sealed short sizeof stackalloc static string struct switch this throw true try
        typeof uint ulong unchecked unsafe ushort using virtual void volatile while add alias
        ascending async await by descending dynamic equals from get global group into join let
        nameof notnull on orderby partial remove select set unmanaged value var when where
        yield""",
    "java": """abstract assert boolean break byte case catch char class const continue default do
        double else enum extends final finally float for goto if implements import instanceof int
        interface long native new package private protected public return short static strictfp
        super switch synchronized this throw throws transient try void volatile while""",
    "javascript": """abstract arguments await boolean break byte case catch char class const
        continue debugger default delete do double else enum eval export extends false final
        finally float for function goto if implements import in instanceof int interface let long
        native new null package private protected public return short static super switch
        synchronized this throw throws transient true try typeof var void volatile while with
        yield""",
    "php": """__halt_compiler abstract and array as break callable case catch class clone const
        continue declare default die do echo else elseif empty enddeclare endfor endforeach endif
        endswitch endwhile eval exit extends final finally fn for foreach function global goto if
        implements include include_once instanceof insteadof interface isset list match namespace
        new or print private protected public readonly require require_once return static switch
        throw trait try unset use var while xor yield""",
    "python": """False await else import pass None break except in raise True class finally is
        return and continue for lambda try as def from nonlocal while assert del global not with
        async elif if or yield""",
    "ruby": """__ENCODING__ __LINE__ __FILE__ BEGIN END alias and begin break case class def
        defined? do else elsif end ensure false for if in module next nil not or redo rescue retry
        return self super then true undef unless until when while yield""",
}

# Words a variable cannot be named, beside the keywords above: the go keywords, common
# literals, and the layout markers of python token strings.
EXTRA_RESERVED: dict[str, str] = {
    "go": """break case chan const continue default defer else fallthrough for func go goto if
        import interface map package range return select struct switch type var int string bool
        byte true false nil""",
    "c": "true false NULL",
    "c_sharp": "",
    "java": "true false null",
    "javascript": "undefined",
    "php": "true false null TRUE FALSE NULL",
    "python": "NEWLINE INDENT DEDENT",
    "ruby": "",
}


def keyword_list(lang: str) -> list[str]:
    return sorted(set(KEYWORDS.get(lang, "").split()))


def reserved_list(lang: str) -> list[str]:
    base = lang if lang != "cpp" else "c"
    return sorted(set(KEYWORDS.get(base, "").split()) | set(EXTRA_RESERVED.get(base, "").split()))


def _in_list(token: Column, lang: Column, values: dict[str, list[str]]) -> Column:
    """Hash-set membership per language; the lists are fixed, so they travel with the plan."""
    out = F.lit(False)
    for name, items in values.items():
        if items:
            out = F.when(lang == name, token.isin(*items)).otherwise(out)
    return out


def is_keyword(token: Column, lang: Column) -> Column:
    return _in_list(token, lang, {k: keyword_list(k) for k in KEYWORDS})


def is_reserved(token: Column, lang: Column) -> Column:
    """Words that are never variables, per language."""
    return _in_list(token, lang, {k: reserved_list(k) for k in (*LANGUAGES, "cpp")})


def keyword_table(spark: SparkSession) -> DataFrame:
    """(lang, keyword): at most a few hundred rows, safe to broadcast."""
    rows = [(lang, kw) for lang in KEYWORDS for kw in keyword_list(lang)]
    return spark.createDataFrame(rows, "lang string, keyword string")


# Shapes of code that never runs. {v} is the control variable, {b} the body.
# Each kind lists (upper bound of the variant draw, template).
_C_WHILE = [(0.33, "while ( false ) { {b} }"), (0.66, "while ( {v} < {v} ) { {b} }"), (1.0, "while ( {v} > {v} ) { {b} }")]
_C_IF = [(0.33, "if ( false ) { {b} }"), (0.66, "if ( {v} < {v} ) { {b} }"), (1.0, "if ( {v} > {v} ) { {b} }")]
_C_FOR = [(0.5, "for ( int {v} = 0 ; {v} > 0 ; {v} ++ ) { {b} }"), (1.0, "for ( ; false ; ) { {b} }")]
DEAD_TEMPLATES: dict[str, dict[str, list[tuple[float, str]]]] = {
    "c": {"for": _C_FOR, "while": _C_WHILE, "if": _C_IF},
    "cpp": {"for": _C_FOR, "while": _C_WHILE, "if": _C_IF},
    "c_sharp": {"for": _C_FOR, "while": _C_WHILE, "if": _C_IF},
    "java": {"for": _C_FOR, "while": _C_WHILE, "if": _C_IF},
    "javascript": {
        "for": [(0.5, "for ( let {v} = 0 ; {v} > 0 ; {v} ++ ) { {b} }"), (1.0, "for ( ; false ; ) { {b} }")],
        "while": _C_WHILE,
        "if": _C_IF,
    },
    "php": {
        "for": [(0.5, "for ( {v} = 0 ; {v} > 0 ; {v} ++ ) { {b} }"), (1.0, "for ( ; FALSE ; ) { {b} }")],
        "while": [(0.33, "while ( FALSE ) { {b} }"), (0.66, "while ( {v} < {v} ) { {b} }"), (1.0, "while ( {v} > {v} ) { {b} }")],
        "if": [(0.33, "if ( FALSE ) { {b} }"), (0.66, "if ( {v} < {v} ) { {b} }"), (1.0, "if ( {v} > {v} ) { {b} }")],
    },
    "go": {
        "for": [(1.0, "for {v} := 0 ; {v} < 0 ; {v} ++ { {b} }")],
        "while": [(0.33, "for false { {b} }"), (0.66, "for {v} > {v} { {b} }"), (1.0, "for {v} < {v} { {b} }")],
        "if": [(0.33, "if false { {b} }"), (0.66, "if {v} > {v} { {b} }"), (1.0, "if {v} < {v} { {b} }")],
    },
    # "until false" does run in ruby; the shape is kept as data.
    "ruby": {
        "for": [(1.0, "for {v} in 0 .. 0 do {b} end")],
        "while": [(0.33, "until false do {b} end"), (0.66, "until {v} < {v} do {b} end"), (1.0, "until {v} > {v} do {b} end")],
        "if": [(0.33, "if false then {b} end"), (0.66, "if {v} < {v} then {b} end"), (1.0, "if {v} > {v} then {b} end")],
    },
    "python": {
        "for": [(1.0, "NEWLINE for {v} in range ( 0 ) : NEWLINE INDENT {b} NEWLINE DEDENT")],
        "while": [
            (0.33, "while False : NEWLINE INDENT {b} NEWLINE DEDENT"),
            (0.66, "while {v} < {v} : NEWLINE INDENT {b} NEWLINE DEDENT"),
            (1.0, "while {v} > {v} : NEWLINE INDENT {b} NEWLINE DEDENT"),
        ],
        "if": [
            (0.33, "if False : NEWLINE INDENT {b} NEWLINE DEDENT"),
            (0.66, "if {v} < {v} : NEWLINE INDENT {b} NEWLINE DEDENT"),
            (1.0, "if {v} > {v} : NEWLINE INDENT {b} NEWLINE DEDENT"),
        ],
    },
}
DEAD_KINDS = ("for", "while", "if")


def dead_template_rows() -> list[tuple[str, str, int, float, float, str]]:
    """(lang, kind, variant, lower, upper, template); the draw u picks lower <= u < upper."""
    rows = []
    for lang, kinds in DEAD_TEMPLATES.items():
        for kind, variants in kinds.items():
            low = 0.0
            for n, (up, template) in enumerate(variants):
                rows.append((lang, kind, n, low, up, template))
                low = up
    return rows


# Weights of the rewrites and the settings of the preparation job.
REWRITE_WEIGHTS = {
    "BlockSwap": 6,
    "ConfusionRemover": 10,
    "ForWhileTransformer": 2,
    "OperandSwap": 1,
    "DeadCodeInserter": 1,
    "VarRenamer": 1,
}
MAX_FUNCTION_LENGTH = 400
BIDIRECTION = "adaptive"
ADAPTIVE_FLIPS = ("BlockSwap", "ForWhileTransformer", "OperandSwap")
VALID_SHARE = 0.001
NOISE_RATIO = 0.15
