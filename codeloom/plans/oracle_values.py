"""Fixed values of the oracles, written out: patterns, marks, word lists and templates.

The oracles take nothing from the code they check, so a wrong pattern or list there does not pass unseen.
"""

from __future__ import annotations

# Patterns of tokens and comments.
STRING = '"(?:[^"\\\\\\n]|\\\\.)*"|\'(?:[^\'\\\\\\n]|\\\\.)*\'|`[^`]*`'
TRIPLE = '"""(?s:.*?)"""|\'\'\'(?s:.*?)\'\'\''
NAME = '[\\p{L}_][\\p{L}\\p{N}_]*'
NAME_DOLLAR = '[\\p{L}_$][\\p{L}\\p{N}_$]*'
NUMBER = '\\d+(?:\\.\\d+)?[\\p{L}\\p{N}_]*'
OPERATOR = '===|!==|<=>|\\.\\.\\.|<<=|>>=|[<>=!+\\-*/%&|^]=|\\+\\+|--|&&|\\|\\||->|=>|::|:=|<<|>>|<>|\\*\\*|\\?\\?|\\.\\.'
LEX_C = '//[^\\n]*|/\\*(?s:.*?)\\*/|"(?:[^"\\\\\\n]|\\\\.)*"|\'(?:[^\'\\\\\\n]|\\\\.)*\'|`[^`]*`|[\\p{L}_][\\p{L}\\p{N}_]*|\\d+(?:\\.\\d+)?[\\p{L}\\p{N}_]*|===|!==|<=>|\\.\\.\\.|<<=|>>=|[<>=!+\\-*/%&|^]=|\\+\\+|--|&&|\\|\\||->|=>|::|:=|<<|>>|<>|\\*\\*|\\?\\?|\\.\\.|\\S'
LEX_DOLLAR = '//[^\\n]*|/\\*(?s:.*?)\\*/|"(?:[^"\\\\\\n]|\\\\.)*"|\'(?:[^\'\\\\\\n]|\\\\.)*\'|`[^`]*`|[\\p{L}_$][\\p{L}\\p{N}_$]*|\\d+(?:\\.\\d+)?[\\p{L}\\p{N}_]*|===|!==|<=>|\\.\\.\\.|<<=|>>=|[<>=!+\\-*/%&|^]=|\\+\\+|--|&&|\\|\\||->|=>|::|:=|<<|>>|<>|\\*\\*|\\?\\?|\\.\\.|\\S'
LEX_PHP = '//[^\\n]*|/\\*(?s:.*?)\\*/|#[^\\n]*|"(?:[^"\\\\\\n]|\\\\.)*"|\'(?:[^\'\\\\\\n]|\\\\.)*\'|`[^`]*`|<\\?php|\\?>|[\\p{L}_$][\\p{L}\\p{N}_$]*|\\d+(?:\\.\\d+)?[\\p{L}\\p{N}_]*|===|!==|<=>|\\.\\.\\.|<<=|>>=|[<>=!+\\-*/%&|^]=|\\+\\+|--|&&|\\|\\||->|=>|::|:=|<<|>>|<>|\\*\\*|\\?\\?|\\.\\.|\\S'
LEX_RUBY = '#[^\\n]*|"(?:[^"\\\\\\n]|\\\\.)*"|\'(?:[^\'\\\\\\n]|\\\\.)*\'|`[^`]*`|(?:@@?|\\$)?[\\p{L}_][\\p{L}\\p{N}_]*|\\d+(?:\\.\\d+)?[\\p{L}\\p{N}_]*|===|!==|<=>|\\.\\.\\.|<<=|>>=|[<>=!+\\-*/%&|^]=|\\+\\+|--|&&|\\|\\||->|=>|::|:=|<<|>>|<>|\\*\\*|\\?\\?|\\.\\.|\\S'
NORMAL_C = '"(?:[^"\\\\\\n]|\\\\.)*"|\'(?:[^\'\\\\\\n]|\\\\.)*\'|`[^`]*`|[\\p{L}_][\\p{L}\\p{N}_]*|\\d+(?:\\.\\d+)?[\\p{L}\\p{N}_]*|===|!==|<=>|\\.\\.\\.|<<=|>>=|[<>=!+\\-*/%&|^]=|\\+\\+|--|&&|\\|\\||->|=>|::|:=|<<|>>|<>|\\*\\*|\\?\\?|\\.\\.|\\S'
NORMAL_DOLLAR = '"(?:[^"\\\\\\n]|\\\\.)*"|\'(?:[^\'\\\\\\n]|\\\\.)*\'|`[^`]*`|[\\p{L}_$][\\p{L}\\p{N}_$]*|\\d+(?:\\.\\d+)?[\\p{L}\\p{N}_]*|===|!==|<=>|\\.\\.\\.|<<=|>>=|[<>=!+\\-*/%&|^]=|\\+\\+|--|&&|\\|\\||->|=>|::|:=|<<|>>|<>|\\*\\*|\\?\\?|\\.\\.|\\S'
NORMAL_PHP = '"(?:[^"\\\\\\n]|\\\\.)*"|\'(?:[^\'\\\\\\n]|\\\\.)*\'|`[^`]*`|<\\?php|\\?>|[\\p{L}_$][\\p{L}\\p{N}_$]*|\\d+(?:\\.\\d+)?[\\p{L}\\p{N}_]*|===|!==|<=>|\\.\\.\\.|<<=|>>=|[<>=!+\\-*/%&|^]=|\\+\\+|--|&&|\\|\\||->|=>|::|:=|<<|>>|<>|\\*\\*|\\?\\?|\\.\\.|\\S'
NORMAL_RUBY = '"(?:[^"\\\\\\n]|\\\\.)*"|\'(?:[^\'\\\\\\n]|\\\\.)*\'|`[^`]*`|(?:@@?|\\$)?[\\p{L}_][\\p{L}\\p{N}_]*|\\d+(?:\\.\\d+)?[\\p{L}\\p{N}_]*|===|!==|<=>|\\.\\.\\.|<<=|>>=|[<>=!+\\-*/%&|^]=|\\+\\+|--|&&|\\|\\||->|=>|::|:=|<<|>>|<>|\\*\\*|\\?\\?|\\.\\.|\\S'
LINES_GO = '//[^\\n]*|/\\*(?s:.*?)\\*/|"(?:[^"\\\\\\n]|\\\\.)*"|\'(?:[^\'\\\\\\n]|\\\\.)*\'|`[^`]*`|[\\p{L}_][\\p{L}\\p{N}_]*|\\d+(?:\\.\\d+)?[\\p{L}\\p{N}_]*|===|!==|<=>|\\.\\.\\.|<<=|>>=|[<>=!+\\-*/%&|^]=|\\+\\+|--|&&|\\|\\||->|=>|::|:=|<<|>>|<>|\\*\\*|\\?\\?|\\.\\.|\\n|\\S'
LINES_DOLLAR = '//[^\\n]*|/\\*(?s:.*?)\\*/|"(?:[^"\\\\\\n]|\\\\.)*"|\'(?:[^\'\\\\\\n]|\\\\.)*\'|`[^`]*`|[\\p{L}_$][\\p{L}\\p{N}_$]*|\\d+(?:\\.\\d+)?[\\p{L}\\p{N}_]*|===|!==|<=>|\\.\\.\\.|<<=|>>=|[<>=!+\\-*/%&|^]=|\\+\\+|--|&&|\\|\\||->|=>|::|:=|<<|>>|<>|\\*\\*|\\?\\?|\\.\\.|\\n|\\S'
LINES_RUBY = '#[^\\n]*|"(?:[^"\\\\\\n]|\\\\.)*"|\'(?:[^\'\\\\\\n]|\\\\.)*\'|`[^`]*`|(?:@@?|\\$)?[\\p{L}_][\\p{L}\\p{N}_]*|\\d+(?:\\.\\d+)?[\\p{L}\\p{N}_]*|===|!==|<=>|\\.\\.\\.|<<=|>>=|[<>=!+\\-*/%&|^]=|\\+\\+|--|&&|\\|\\||->|=>|::|:=|<<|>>|<>|\\*\\*|\\?\\?|\\.\\.|\\n|\\S'
LINE_ENDING = '^(?:[\\p{L}\\p{N}_$@\\"\'`].*|[)\\]}]|\\+\\+|--)$'
STRIP_BRACE = '//[^\\n]*|/\\*(?s:.*?)\\*/|\'(?:\\\\(?s:.)|[^\\\\\'])*\'|"(?:\\\\(?s:.)|[^\\\\"])*"'
STRIP_PYTHON = '"""(?s:.*?)"""|\'\'\'(?s:.*?)\'\'\'|"(?:[^"\\\\\\n]|\\\\.)*"|\'(?:[^\'\\\\\\n]|\\\\.)*\'|`[^`]*`|#[^\\n]*'

# Marks and patterns of the rewrites.
OPEN = '\ue000'
CLOSE = '\ue001'
LINE = '\ue002'
SEMI = '\ue004'
CUT = '\ue005'
BRACE_LANGS = ('c', 'cpp', 'c_sharp', 'java', 'javascript', 'php')
RELATIONAL = ('<', '>', '<=', '>=', '==', '!=')
MIRROR = {'<': '>', '>': '<', '<=': '>=', '>=': '<='}
NEGATE = {'<': '>=', '>': '<=', '>=': '<', '<=': '>', '==': '!=', '!=': '=='}
COMPARISON = '((?:[!~-] )?(?:[\\p{L}\\p{N}_$@]+(?:\\.\\d+)?|\\"\\d+\\"|\\( [^()]*\\))(?: (?:\\.|->|::) (?:[\\p{L}\\p{N}_$@]+(?:\\.\\d+)?|\\"\\d+\\"|\\( [^()]*\\))| \\( (?:[^()]*)\\)| \\[ [^\\[\\]]*\\])*(?: [+*/%-] (?:[!~-] )?(?:[\\p{L}\\p{N}_$@]+(?:\\.\\d+)?|\\"\\d+\\"|\\( [^()]*\\))(?: (?:\\.|->|::) (?:[\\p{L}\\p{N}_$@]+(?:\\.\\d+)?|\\"\\d+\\"|\\( [^()]*\\))| \\( (?:[^()]*)\\)| \\[ [^\\[\\]]*\\])*)*) (===|!==|==|!=|<=|>=|<>|<|>) ((?:[!~-] )?(?:[\\p{L}\\p{N}_$@]+(?:\\.\\d+)?|\\"\\d+\\"|\\( [^()]*\\))(?: (?:\\.|->|::) (?:[\\p{L}\\p{N}_$@]+(?:\\.\\d+)?|\\"\\d+\\"|\\( [^()]*\\))| \\( (?:[^()]*)\\)| \\[ [^\\[\\]]*\\])*(?: [+*/%-] (?:[!~-] )?(?:[\\p{L}\\p{N}_$@]+(?:\\.\\d+)?|\\"\\d+\\"|\\( [^()]*\\))(?: (?:\\.|->|::) (?:[\\p{L}\\p{N}_$@]+(?:\\.\\d+)?|\\"\\d+\\"|\\( [^()]*\\))| \\( (?:[^()]*)\\)| \\[ [^\\[\\]]*\\])*)*)'
BEFORE_COMPARISON = '^$|(?:^|[(=?:!;{}&|\\[]|\\b(?:return|if|while|and|or|not|elif|elsif|unless|until|then|do|in|when|case|else|NEWLINE|INDENT|DEDENT)) $'
AFTER_COMPARISON = '^(?:$| (?:[);?:&|\\]{}]|(?:and|or|then|do|if|else|NEWLINE)\\b))'
AT_WORD = '^$| $'
BINARY_OPERATOR = ' (?:===|!==|==|!=|<=|>=|<|>|&&|\\|\\||[+*/%&|^-]) '
POST_STEP = '(^|[;{})] |else )([\\p{L}_$][\\p{L}\\p{N}_$]*) = ([\\p{L}_$][\\p{L}\\p{N}_$]*) ([+-])[+-] ;'
PRE_STEP = '(^|[;{})] |else )([\\p{L}_$][\\p{L}\\p{N}_$]*) = ([+-])[+-] ([\\p{L}_$][\\p{L}\\p{N}_$]*) ;'
TERNARY_ASSIGN = '(^|[;{})] |else )([\\p{L}_$][\\p{L}\\p{N}_$]*) = (?:\\( ([^();?:{}]*?) \\)|([^;?:{}]*?)) \\? ([^;?:{}]*) : ([^;?:{}]*) ;'
TERNARY_DECLARE = '(^|[;{}] )([\\p{L}_$][\\p{L}\\p{N}_$]* (?:[\\p{L}_$][\\p{L}\\p{N}_$]* |[<>,.*&\\[\\]] )*)([\\p{L}_$][\\p{L}\\p{N}_$]*) = (?:\\( ([^();?:{}]*?) \\)|([^;?:{}]*?)) \\? ([^;?:{}]*) : ([^;?:{}]*) ;'
TERNARY_RETURN = '(^| )return (?:\\( ([^();?:{}]*?) \\)|([^;?:{}]*?)) \\? ([^;?:{}]*) : ([^;?:{}]*) ;'
IMPORT_TOKENS = '\\b(?:import|package) [^;{}]*; ?'
FOR_HEADER = 'for ([^;{}]*); ([^;{}]*); ([^;{}]*[){])'
STATEMENT = '[^;{}\ue002\ue004\\s][^;{}\ue002]* ;'
STATEMENT_LINES = '[^;{}\ue002\ue004\\s][^;{}\ue002]* [;\ue002]'
STATEMENT_PYTHON = '[^\ue000\ue001\ue002\\s][^\ue000\ue001\ue002]* \ue002'
RUBY_HEADS = '(def \\S+ \\( [^()]*\\)|\\b(?:then|else|do|end|begin)) '
RUBY_CONTROL = '\\b(?:if|unless|while|until|for|begin|case|def|class|module|do|end|then|else|elsif|when)\\b'

# Tokens that end a statement, assign, or step.
ENDS = (';', '{', '}', 'NEWLINE', 'INDENT', 'DEDENT')
ASSIGNS = ('=', ':=', '+=', '-=', '*=', '/=', '%=', '&=', '|=', '^=')
STEPS = ('++', '--')

# Languages, keywords and words that are never variables.
LANGUAGES = ('c', 'c_sharp', 'go', 'java', 'javascript', 'php', 'python', 'ruby')
CONFUSION_LANGUAGES = ('java', 'c', 'cpp', 'c_sharp')
KEYWORDS = {
    'c': (
        '_Alignas _Alignof _Atomic _Bool _Complex _Decimal128 _Decimal32 _Decimal64 _Generic _Imaginary '
        '_Noreturn _Static_assert _Thread_local __has_c_attribute auto break case char const continue default '
        'define defined do double elif else endif enum error extern float for goto if ifdef ifndef include '
        'inline int line long pragma register restrict return short signed sizeof static struct switch '
        'typedef undef union unsigned void volatile while'
    ).split(),
    'c_sharp': (
        'abstract add alias as ascending async await base bool break by byte case catch char checked class '
        'const continue decimal default delegate descending do double dynamic else enum equals event explicit '
        'extern false finally fixed float for foreach from get global goto group if implicit in int interface '
        'internal into is join let lock long nameof namespace new notnull null object on operator orderby out '
        'override params partial private protected public readonly ref remove return sbyte sealed select set '
        'short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked '
        'unmanaged unsafe ushort using value var virtual void volatile when where while yield'
    ).split(),
    'java': (
        'abstract assert boolean break byte case catch char class const continue default do double else enum '
        'extends final finally float for goto if implements import instanceof int interface long native new '
        'package private protected public return short static strictfp super switch synchronized this throw '
        'throws transient try void volatile while'
    ).split(),
    'javascript': (
        'abstract arguments await boolean break byte case catch char class const continue debugger default '
        'delete do double else enum eval export extends false final finally float for function goto if '
        'implements import in instanceof int interface let long native new null package private protected '
        'public return short static super switch synchronized this throw throws transient true try typeof var '
        'void volatile while with yield'
    ).split(),
    'php': (
        '__halt_compiler abstract and array as break callable case catch class clone const continue declare '
        'default die do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile eval '
        'exit extends final finally fn for foreach function global goto if implements include include_once '
        'instanceof insteadof interface isset list match namespace new or print private protected public '
        'readonly require require_once return static switch throw trait try unset use var while xor yield'
    ).split(),
    'python': (
        'False None True and as assert async await break class continue def del elif else except finally for '
        'from global if import in is lambda nonlocal not or pass raise return try while with yield'
    ).split(),
    'ruby': (
        'BEGIN END __ENCODING__ __FILE__ __LINE__ alias and begin break case class def defined? do else elsif '
        'end ensure false for if in module next nil not or redo rescue retry return self super then true '
        'undef unless until when while yield'
    ).split(),
}
RESERVED = {
    'c': (
        'NULL _Alignas _Alignof _Atomic _Bool _Complex _Decimal128 _Decimal32 _Decimal64 _Generic _Imaginary '
        '_Noreturn _Static_assert _Thread_local __has_c_attribute auto break case char const continue default '
        'define defined do double elif else endif enum error extern false float for goto if ifdef ifndef '
        'include inline int line long pragma register restrict return short signed sizeof static struct '
        'switch true typedef undef union unsigned void volatile while'
    ).split(),
    'c_sharp': (
        'abstract add alias as ascending async await base bool break by byte case catch char checked class '
        'const continue decimal default delegate descending do double dynamic else enum equals event explicit '
        'extern false finally fixed float for foreach from get global goto group if implicit in int interface '
        'internal into is join let lock long nameof namespace new notnull null object on operator orderby out '
        'override params partial private protected public readonly ref remove return sbyte sealed select set '
        'short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked '
        'unmanaged unsafe ushort using value var virtual void volatile when where while yield'
    ).split(),
    'go': (
        'bool break byte case chan const continue default defer else fallthrough false for func go goto if '
        'import int interface map nil package range return select string struct switch true type var'
    ).split(),
    'java': (
        'abstract assert boolean break byte case catch char class const continue default do double else enum '
        'extends false final finally float for goto if implements import instanceof int interface long native '
        'new null package private protected public return short static strictfp super switch synchronized '
        'this throw throws transient true try void volatile while'
    ).split(),
    'javascript': (
        'abstract arguments await boolean break byte case catch char class const continue debugger default '
        'delete do double else enum eval export extends false final finally float for function goto if '
        'implements import in instanceof int interface let long native new null package private protected '
        'public return short static super switch synchronized this throw throws transient true try typeof '
        'undefined var void volatile while with yield'
    ).split(),
    'php': (
        'FALSE NULL TRUE __halt_compiler abstract and array as break callable case catch class clone const '
        'continue declare default die do echo else elseif empty enddeclare endfor endforeach endif endswitch '
        'endwhile eval exit extends false final finally fn for foreach function global goto if implements '
        'include include_once instanceof insteadof interface isset list match namespace new null or print '
        'private protected public readonly require require_once return static switch throw trait true try '
        'unset use var while xor yield'
    ).split(),
    'python': (
        'DEDENT False INDENT NEWLINE None True and as assert async await break class continue def del elif '
        'else except finally for from global if import in is lambda nonlocal not or pass raise return try '
        'while with yield'
    ).split(),
    'ruby': (
        'BEGIN END __ENCODING__ __FILE__ __LINE__ alias and begin break case class def defined? do else elsif '
        'end ensure false for if in module next nil not or redo rescue retry return self super then true '
        'undef unless until when while yield'
    ).split(),
    'cpp': (
        'NULL _Alignas _Alignof _Atomic _Bool _Complex _Decimal128 _Decimal32 _Decimal64 _Generic _Imaginary '
        '_Noreturn _Static_assert _Thread_local __has_c_attribute auto break case char const continue default '
        'define defined do double elif else endif enum error extern false float for goto if ifdef ifndef '
        'include inline int line long pragma register restrict return short signed sizeof static struct '
        'switch true typedef undef union unsigned void volatile while'
    ).split(),
}

# Dead-code templates as (lang, kind, lower and upper bound of the draw, template).
DEAD_TEMPLATES = [
    ('c', 'for', 0.0, 0.5, 'for ( int {v} = 0 ; {v} > 0 ; {v} ++ ) { {b} }'),
    ('c', 'for', 0.5, 1.0, 'for ( ; false ; ) { {b} }'),
    ('c', 'while', 0.0, 0.33, 'while ( false ) { {b} }'),
    ('c', 'while', 0.33, 0.66, 'while ( {v} < {v} ) { {b} }'),
    ('c', 'while', 0.66, 1.0, 'while ( {v} > {v} ) { {b} }'),
    ('c', 'if', 0.0, 0.33, 'if ( false ) { {b} }'),
    ('c', 'if', 0.33, 0.66, 'if ( {v} < {v} ) { {b} }'),
    ('c', 'if', 0.66, 1.0, 'if ( {v} > {v} ) { {b} }'),
    ('cpp', 'for', 0.0, 0.5, 'for ( int {v} = 0 ; {v} > 0 ; {v} ++ ) { {b} }'),
    ('cpp', 'for', 0.5, 1.0, 'for ( ; false ; ) { {b} }'),
    ('cpp', 'while', 0.0, 0.33, 'while ( false ) { {b} }'),
    ('cpp', 'while', 0.33, 0.66, 'while ( {v} < {v} ) { {b} }'),
    ('cpp', 'while', 0.66, 1.0, 'while ( {v} > {v} ) { {b} }'),
    ('cpp', 'if', 0.0, 0.33, 'if ( false ) { {b} }'),
    ('cpp', 'if', 0.33, 0.66, 'if ( {v} < {v} ) { {b} }'),
    ('cpp', 'if', 0.66, 1.0, 'if ( {v} > {v} ) { {b} }'),
    ('c_sharp', 'for', 0.0, 0.5, 'for ( int {v} = 0 ; {v} > 0 ; {v} ++ ) { {b} }'),
    ('c_sharp', 'for', 0.5, 1.0, 'for ( ; false ; ) { {b} }'),
    ('c_sharp', 'while', 0.0, 0.33, 'while ( false ) { {b} }'),
    ('c_sharp', 'while', 0.33, 0.66, 'while ( {v} < {v} ) { {b} }'),
    ('c_sharp', 'while', 0.66, 1.0, 'while ( {v} > {v} ) { {b} }'),
    ('c_sharp', 'if', 0.0, 0.33, 'if ( false ) { {b} }'),
    ('c_sharp', 'if', 0.33, 0.66, 'if ( {v} < {v} ) { {b} }'),
    ('c_sharp', 'if', 0.66, 1.0, 'if ( {v} > {v} ) { {b} }'),
    ('java', 'for', 0.0, 0.5, 'for ( int {v} = 0 ; {v} > 0 ; {v} ++ ) { {b} }'),
    ('java', 'for', 0.5, 1.0, 'for ( ; false ; ) { {b} }'),
    ('java', 'while', 0.0, 0.33, 'while ( false ) { {b} }'),
    ('java', 'while', 0.33, 0.66, 'while ( {v} < {v} ) { {b} }'),
    ('java', 'while', 0.66, 1.0, 'while ( {v} > {v} ) { {b} }'),
    ('java', 'if', 0.0, 0.33, 'if ( false ) { {b} }'),
    ('java', 'if', 0.33, 0.66, 'if ( {v} < {v} ) { {b} }'),
    ('java', 'if', 0.66, 1.0, 'if ( {v} > {v} ) { {b} }'),
    ('javascript', 'for', 0.0, 0.5, 'for ( let {v} = 0 ; {v} > 0 ; {v} ++ ) { {b} }'),
    ('javascript', 'for', 0.5, 1.0, 'for ( ; false ; ) { {b} }'),
    ('javascript', 'while', 0.0, 0.33, 'while ( false ) { {b} }'),
    ('javascript', 'while', 0.33, 0.66, 'while ( {v} < {v} ) { {b} }'),
    ('javascript', 'while', 0.66, 1.0, 'while ( {v} > {v} ) { {b} }'),
    ('javascript', 'if', 0.0, 0.33, 'if ( false ) { {b} }'),
    ('javascript', 'if', 0.33, 0.66, 'if ( {v} < {v} ) { {b} }'),
    ('javascript', 'if', 0.66, 1.0, 'if ( {v} > {v} ) { {b} }'),
    ('php', 'for', 0.0, 0.5, 'for ( {v} = 0 ; {v} > 0 ; {v} ++ ) { {b} }'),
    ('php', 'for', 0.5, 1.0, 'for ( ; FALSE ; ) { {b} }'),
    ('php', 'while', 0.0, 0.33, 'while ( FALSE ) { {b} }'),
    ('php', 'while', 0.33, 0.66, 'while ( {v} < {v} ) { {b} }'),
    ('php', 'while', 0.66, 1.0, 'while ( {v} > {v} ) { {b} }'),
    ('php', 'if', 0.0, 0.33, 'if ( FALSE ) { {b} }'),
    ('php', 'if', 0.33, 0.66, 'if ( {v} < {v} ) { {b} }'),
    ('php', 'if', 0.66, 1.0, 'if ( {v} > {v} ) { {b} }'),
    ('go', 'for', 0.0, 1.0, 'for {v} := 0 ; {v} < 0 ; {v} ++ { {b} }'),
    ('go', 'while', 0.0, 0.33, 'for false { {b} }'),
    ('go', 'while', 0.33, 0.66, 'for {v} > {v} { {b} }'),
    ('go', 'while', 0.66, 1.0, 'for {v} < {v} { {b} }'),
    ('go', 'if', 0.0, 0.33, 'if false { {b} }'),
    ('go', 'if', 0.33, 0.66, 'if {v} > {v} { {b} }'),
    ('go', 'if', 0.66, 1.0, 'if {v} < {v} { {b} }'),
    ('ruby', 'for', 0.0, 1.0, 'for {v} in 0 .. 0 do {b} end'),
    ('ruby', 'while', 0.0, 0.33, 'until false do {b} end'),
    ('ruby', 'while', 0.33, 0.66, 'until {v} < {v} do {b} end'),
    ('ruby', 'while', 0.66, 1.0, 'until {v} > {v} do {b} end'),
    ('ruby', 'if', 0.0, 0.33, 'if false then {b} end'),
    ('ruby', 'if', 0.33, 0.66, 'if {v} < {v} then {b} end'),
    ('ruby', 'if', 0.66, 1.0, 'if {v} > {v} then {b} end'),
    ('python', 'for', 0.0, 1.0, 'NEWLINE for {v} in range ( 0 ) : NEWLINE INDENT {b} NEWLINE DEDENT'),
    ('python', 'while', 0.0, 0.33, 'while False : NEWLINE INDENT {b} NEWLINE DEDENT'),
    ('python', 'while', 0.33, 0.66, 'while {v} < {v} : NEWLINE INDENT {b} NEWLINE DEDENT'),
    ('python', 'while', 0.66, 1.0, 'while {v} > {v} : NEWLINE INDENT {b} NEWLINE DEDENT'),
    ('python', 'if', 0.0, 0.33, 'if False : NEWLINE INDENT {b} NEWLINE DEDENT'),
    ('python', 'if', 0.33, 0.66, 'if {v} < {v} : NEWLINE INDENT {b} NEWLINE DEDENT'),
    ('python', 'if', 0.66, 1.0, 'if {v} > {v} : NEWLINE INDENT {b} NEWLINE DEDENT'),
]

# Settings of the preparation job and special ids.
REWRITE_WEIGHTS = {'BlockSwap': 6, 'ConfusionRemover': 10, 'ForWhileTransformer': 2, 'OperandSwap': 1, 'DeadCodeInserter': 1, 'VarRenamer': 1}
MAX_FUNCTION_LENGTH = 400
PAD = 0
EOS = 2
UNK = 3
FIRST_ID = 4
