"""Lexers and parsing-expression grammars of the judged languages."""

from __future__ import annotations

import re
from collections.abc import Callable

from lodestrata.llm.peg import END, Codes, Grammar

Lexed = tuple[str, list[int], int | None]  # codes, places of tokens, place of a lexical error


def alternatives(texts: list[str]) -> str:
    return "|".join(re.escape(x) for x in sorted(texts, key=len, reverse=True))


def any_of(texts: str) -> str:
    return " / ".join(f"'{x}'" for x in texts.split())


# ---------------------------------------------------------------- JavaScript and TypeScript
SCRIPT_RESERVED = "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new null return super switch this throw true try typeof var void while with false"
SCRIPT_NAMES = "async await of get set static let yield as from type interface abstract declare readonly namespace module keyof infer is asserts public private protected implements override satisfies unique accessor package global require out"
SCRIPT_PUNCT = "{ } ( ) [ ] ; , < > <= == != === !== + - * / % ** ++ -- << & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= => . ... @"
SCRIPT_CODES = Codes(["ID", "NUM", "STR", "TMPL", "REGEX", "PRIV", "THEAD", "TMID", "TTAIL"], [*SCRIPT_RESERVED.split(), *SCRIPT_NAMES.split(), *SCRIPT_PUNCT.split()], lines=True)
SPACE = r"(?:[\s\ufeff]++|//[^\n\r\u2028\u2029]*+|/\*(?:[^*]++|\*(?!/))*+\*/)*+"
# a piece of a template ends with it or before a substitution, whose tokens are the file's own
PIECE = r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+(?:`|\$\{)"
SCRIPT_PIECE = re.compile(r"\}" + PIECE)
SCRIPT_TOKEN = re.compile(
    SPACE + r"(?:((?:[^\W\d]|[$\\])(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*+)"
    r"|((?:0[xX][0-9a-fA-F_]++|0[oO][0-7_]++|0[bB][01_]++|(?:\d[\d_]*+)(?:\.[\d_]*+)?+(?:[eE][+-]?\d++)?+|\.\d[\d_]*+(?:[eE][+-]?\d++)?+)n?+(?![\w$]))"
    r"|(\"(?:[^\"\\\n\r]++|\\(?:\r\n|[\s\S]))*+\"|'(?:[^'\\\n\r]++|\\(?:\r\n|[\s\S]))*+')"
    r"|(`" + PIECE + r")"
    r"|(\#[^\W\d]\w*+)|(" + alternatives([x for x in SCRIPT_PUNCT.split()]) + r")|(\Z)|())"
)
SCRIPT_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\r\[]++|\\[^\n\r]|\[(?:[^\]\\\n\r]++|\\[^\n\r])*+\])++/[a-zA-Z]*+")
SCRIPT_WORDS = {**{w: w for w in SCRIPT_RESERVED.split()}, **{w: w for w in SCRIPT_NAMES.split()}}
OPERAND_ENDS = {SCRIPT_CODES.of[x] for x in ("ID", "NUM", "STR", "TMPL", "TTAIL", "REGEX", "PRIV", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", *SCRIPT_NAMES.split())}


def lex_script(text: str) -> Lexed:
    match, of, later = SCRIPT_TOKEN.match, SCRIPT_CODES.of, SCRIPT_CODES.later
    codes, places = [], []
    pos = re.match(r"\ufeff?#![^\n]*", text).end() if text.lstrip("\ufeff").startswith("#!") else 0
    last = ""
    open_braces: list[int] = []  # in each template that is open, outermost first
    words = SCRIPT_WORDS.get
    while True:
        m = match(text, pos)
        k = m.lastindex
        at = m.start(k)
        if k == 7:
            break
        if k == 8:
            return "".join(codes) + END, places, at
        if k == 1:
            kind = words(m[1], "ID")
        elif k == 6:
            kind = m[6]
            if kind in ("/", "/=") and last not in OPERAND_ENDS:
                r = SCRIPT_REGEX.match(text, at)
                if not r:
                    return "".join(codes) + END, places, at
                kind, end = "REGEX", r.end()
                last = of[kind]
                codes.append(later[kind] if text.find("\n", pos, at) >= 0 else last)
                places.append(at)
                pos = end
                continue
            if open_braces and kind == "{":
                open_braces[-1] += 1
            elif open_braces and kind == "}":
                open_braces[-1] -= 1
                if open_braces[-1] < 0:
                    m = SCRIPT_PIECE.match(text, at)
                    if not m:
                        return "".join(codes) + END, places, at
                    kind = "TTAIL" if m[0][-1] == "`" else "TMID"
                    if kind == "TTAIL":
                        open_braces.pop()
                    else:
                        open_braces[-1] = 0
        elif k == 4 and m[4][-1] == "{":
            kind = "THEAD"
            open_braces.append(0)
        else:
            kind = ("", "", "NUM", "STR", "TMPL", "PRIV")[k]
        last = of[kind]
        codes.append(later[kind] if text.find("\n", pos, at) >= 0 else last)
        places.append(at)
        pos = m.end()
    places.append(len(text))
    return "".join(codes) + END, places, None


def script_grammar(ts: bool) -> str:
    t = lambda x: x if ts else ""
    return f"""
file <- stmt* EOF
name <- ID / {any_of(SCRIPT_NAMES)}
word <- name / {any_of(SCRIPT_RESERVED)}
block <- '{{' stmt* '}}'
semi <- ';' / &'}}' / &EOF / NL
stmt <- block / vars / branch / loop / try / switch / leave / function / class {t("/ tsdecl")} / import / export / ';' / name ':' stmt / 'debugger' semi / !('class' / 'function' / '{{') expr semi
vars <- ('var' / 'const' / 'let' &(name / '{{' / '[')) declarator (',' declarator)* semi
declarator <- binding {t("'!'? annotation?")} ('=' assign)?
binding <- name / '{{' (bindprop (',' bindprop)*)? ','? '}}' / '[' ','* (bindelem (','+ bindelem)*)? ','* ']'
bindelem <- '...' binding / binding ('=' assign)?
bindprop <- '...' binding / prop ':' bindelem / name ('=' assign)?
branch <- 'if' '(' expr ')' stmt ('else' stmt)?
loop <- 'for' 'await'? '(' forhead ')' stmt / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';'? / 'with' '(' expr ')' stmt
forhead <- ('var' / 'const' / 'let') binding {t("annotation?")} ('of' assign / 'in' expr) / !(('var' / 'const' / 'let') binding) postfix ('of' assign / 'in' expr) / (('var' / 'const' / 'let') fordecl (',' fordecl)* / expr)? ';' expr? ';' expr?
fordecl <- binding {t("annotation?")} ('=' assign)?
try <- 'try' block ('catch' ('(' binding {t("annotation?")} ')')? block ('finally' block)? / 'finally' block)
switch <- 'switch' '(' expr ')' '{{' (('case' expr / 'default') ':' stmt*)* '}}'
leave <- ('return' / 'throw') (!NL expr)? semi / ('break' / 'continue') (!NL name)? semi
function <- 'async'? 'function' '*'? name {t("typeparams?")} params {t("annotation?")} (block {t("/ semi")})
class <- decorator* {t("'abstract'?")} 'class' name {t("typeparams?")} heritage classbody
decorator <- '@' (name ('.' word)* {t("typeargs?")} args? / '(' expr ')')
heritage <- ('extends' postfix {t("typeargs?")})? {t("('implements' type (',' type)*)?")}
classbody <- '{{' member* '}}'
member <- ';' / 'static' block / decorator* {t("modifier* indexsig semi / decorator*")} (modifier)* (accessor / '*'? prop {t("('?' / '!')?")} (callable {t("/ callsig semi")}) / prop {t("('?' / '!')? annotation?")} ('=' assign)? semi)
modifier <- ('static' / 'async' / 'accessor' {t("/ 'public' / 'private' / 'protected' / 'readonly' / 'abstract' / 'override' / 'declare'")}) !('(' / '=' / ';' / '}}' / ':' / ',' / '?' / '!' / '<')
accessor <- ('get' / 'set') prop (callable {t("/ callsig semi")})
callable <- {t("typeparams?")} params {t("annotation?")} block
prop <- word / STR / NUM / PRIV / '[' assign ']'
params <- '(' (param (',' param)*)? ','? ')'
param <- decorator* {t("('public' / 'private' / 'protected' / 'readonly' / 'override')*")} paramcore
paramcore <- '...' binding {t("annotation?")} / {t("'this' annotation /")} binding {t("'?'? annotation?")} ('=' assign)?
import <- 'import' (STR / {t("'type'? name '=' (name ('.' word)*) args? /")} {t("('type' &(name / '*' / '{'))?")} (name (',' (star / specifiers))? / star / specifiers) 'from' STR) ('with' object)? semi
star <- '*' 'as' name
specifiers <- '{{' (specifier (',' specifier)*)? ','? '}}'
specifier <- {t("('type' &(word / STR))?")} (word / STR) ('as' (word / STR))?
export <- 'export' ('default' (function / class / 'async'? 'function' '*'? params block / 'class' heritage classbody {t("/ tsdecl")} / assign semi) / {t("'type'?")} '*' ('as' word)? 'from' STR semi / {t("'type'?")} specifiers ('from' STR)? semi / {t("'=' expr semi / 'as' 'namespace' name semi / tsdecl /")} vars / function / class)
expr <- assign (',' assign)*
assign <- simple &(',' / ')' / ';' / ']' / '}}') / arrow / 'yield' (!NL '*'? assign)? / binary (assignop assign / '?' assign ':' assign)?
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??=' / '>' '>' '>'? '='
simple <- NUM / STR / name ('.' word)* / 'this' ('.' word)*
arrow <- ('async' !NL)? (name / {t("typeparams?")} params {t("annotation?")}) !NL '=>' (block / assign)
binary <- unary (binop unary {t("/ !NL ('as' / 'satisfies') ('const' / type)")})*
binop <- '+' / '-' / '*' / '/' / '%' / '**' / '<=' / '==' / '!=' / '===' / '!==' / '<<' / '&' / '|' / '^' / '&&' / '||' / '??' / 'in' / 'instanceof' / '<' / '>' '>' '>'? !'=' / '>' '='?
unary <- prefix* {t("(typeargs !'(')?")} (PRIV &'in' / postfix)
prefix <- '+' / '-' / '!' / '~' / '++' / '--' / 'typeof' / 'void' / 'delete' / 'await' !('.' / '(' / ',' / ')' / '=') / 'new' !'.' / 'await' &'('
postfix <- (chain / primary) trailer* (!NL ('++' / '--'))?
chain <- (name !'=>' / NUM / STR / TMPL / REGEX / 'this' / 'super' / 'null' / 'true' / 'false') ('.' (word / PRIV))*
trailer <- '.' (word / PRIV) / '?.' (word / PRIV / '[' expr ']' / args) / '[' expr ']' / args / TMPL / template {t("/ !NL '!' / typeargs &('(' / TMPL / THEAD) / typeargs !(name / STR / NUM / '(' / '-' / '+' / 'this' / 'null')")}
args <- '(' (arg (',' arg)*)? ','? ')'
arg <- '...'? assign
template <- THEAD expr (TMID expr)* TTAIL
primary <- '(' expr ','? ')' / array / object / template / 'async'? 'function' '*'? name? {t("typeparams?")} params {t("annotation?")} block / decorator* 'class' name? {t("typeparams?")} heritage classbody / 'import' ('(' assign (',' assign)? ','? ')' / '.' word) / 'new' '.' word
array <- '[' flat* ','* (element (','+ element)*)? ','* ']'
flat <- ('-'? NUM / STR) ','
element <- '...'? assign
object <- '{{' (property (',' property)*)? ','? '}}'
property <- '...' assign / prop ':' assign / name &(',' / '}}') / name '=' assign / accessor / ('async' !(NL / '(' / ',' / ':'))? '*'? prop callable
""" + (
        """
annotation <- ':' type
type <- 'asserts' name ('is' type)? / (name / 'this') 'is' type / funtype / union ('extends' union '?' type ':' type)?
funtype <- 'abstract'? 'new'? typeparams? params '=>' type
union <- ('|' / '&')? typepost (('|' / '&') typepost)*
typepost <- (('keyof' / 'readonly' / 'unique') &(name / '(' / '[' / '{' / 'typeof' / STR / 'this'))* (('infer' name ('extends' typepost !'?')?) / typeatom) (!NL '[' type? ']')*
typeatom <- funtype / '(' type ')' / typebody / '[' (tuple (',' tuple)*)? ','? ']' / STR / '-'? NUM / TMPL / THEAD type (TMID type)* TTAIL / 'typeof' ('import' args / name) ('.' (word / PRIV))* typeargs? / 'import' args ('.' word)* typeargs? / 'this' / 'null' / 'void' / 'true' / 'false' / name ('.' word)* (!NL typeargs)?
tuple <- '...'? (word '?'? ':' type / type '?'?)
typeargs <- '<' type (',' type)* ','? '>'
typeparams <- '<' typeparam (',' typeparam)* ','? '>'
typeparam <- ('const' / 'in' / 'out')* name ('extends' type)? ('=' type)?
typebody <- '{' (typemember ((';' / ',' / NL) typemember)*)? (';' / ',')? '}' / '{' mapped ';'? '}'
mapped <- (('+' / '-')? 'readonly')? '[' name 'in' type ('as' type)? ']' (('+' / '-')? '?')? (':' type)?
typemember <- indexsig / ('get' / 'set') prop callsig / 'new'? callsig / ('readonly' !(':' / '?' / '(' / ';' / ','))? prop '?'? (callsig / annotation)?
indexsig <- ('readonly')? '[' name ':' type ']' '?'? annotation
callsig <- typeparams? params annotation?
tsdecl <- 'declare'? ('interface' !NL name typeparams? ('extends' type (',' type)*)? typebody / 'type' name typeparams? '=' type semi / 'const'? 'enum' name '{' (prop ('=' assign)? (',' prop ('=' assign)?)*)? ','? '}' / ('namespace' / 'module') !NL (name ('.' word)* / STR) (block / semi) / decorator* 'abstract' class) / 'declare' ('global' block / vars / function / class)
"""
        if ts
        else ""
    )


# ---------------------------------------------------------------- JSON
JSON_CODES = Codes(["STR", "NUM", "LIT"], list("{}[],:"))
JSON_TOKEN = re.compile(r"[ \t\r\n]*+(?:(\"(?:[^\"\\\x00-\x1f]++|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*+\")|(-?+(?:0|[1-9]\d*+)(?:\.\d++)?+(?:[eE][+-]?\d++)?+(?![\w.]))|(true\b|false\b|null\b)|([{}\[\],:])|(\Z)|())")
JSON = """
file <- value EOF
value <- STR / NUM / LIT / object / array
object <- '{' (pair (',' pair)*)? '}'
pair <- flatpair &(',' / '}') / STR ':' value
flatpair <- STR ':' (STR / NUM / LIT)
array <- '[' (value (',' value)*)? ']'
"""


def lex_json(text: str) -> Lexed:
    codes, places, pos, of = [], [], 1 if text.startswith("\ufeff") else 0, JSON_CODES.of
    names = ("", of["STR"], of["NUM"], of["LIT"])
    while True:
        m = JSON_TOKEN.match(text, pos)
        k = m.lastindex
        if k == 5:
            break
        if k == 6:
            return "".join(codes) + END, places, m.start(6)
        codes.append(of[m[4]] if k == 4 else names[k])
        places.append(m.start(k))
        pos = m.end()
    places.append(len(text))
    return "".join(codes) + END, places, None


# ---------------------------------------------------------------- Go
GO_KEYWORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
GO_PUNCT = "( ) { } [ ] , ; . ... : := = == != < > <= >= + - * / % & | ^ &^ << >> && || ! ++ -- <- += -= *= /= %= &= |= ^= <<= >>= &^= ~"
GO_CODES = Codes(["ID", "NUM", "STR", "AUTO"], [*GO_KEYWORDS.split(), *GO_PUNCT.split()])
GO_TOKEN = re.compile(
    r"((?:[ \t\r\n\ufeff]++|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)*+)(?:([^\W\d]\w*+)|((?:0[xX][0-9a-fA-F_.pP+-]++|0[bB][01_]++|0[oO][0-7_]++|\d[\d_]*+(?:\.[\d_]*+)?+(?:[eE][+-]?\d++)?+|\.\d++(?:[eE][+-]?\d++)?+)i?+(?!\w))"
    r"|(\"(?:[^\"\\\n]++|\\(?:[abfnrtv\\\"']|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))*+\"|`[^`]*+`|'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))')|(" + alternatives(GO_PUNCT.split()) + r")|(\Z)|())"
)
GO_ENDS = {GO_CODES.of[x] for x in ("ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}")}
GO = f"""
file <- end* 'package' ID end (import end)* (decl end)* AUTO? EOF
end <- ';' / AUTO
close <- AUTO? ';'?
import <- 'import' (spec / '(' (spec (end spec)*)? end? ')')
spec <- (ID / '.')? STR
decl <- func / constvar / typedecl
constvar <- ('const' / 'var') (varspec / '(' (varspec (end varspec)*)? end? ')')
varspec <- ID (',' ID)* (type ('=' exprs)? / '=' exprs)?
typedecl <- 'type' (typespec / '(' (typespec (end typespec)*)? end? ')')
typespec <- ID (typeparams !(end / ']'))? '='? type / ID '='? type
typeparams <- '[' typeparam (',' typeparam)* ','? ']'
typeparam <- ID (',' ID)* constraint
constraint <- '~'? type ('|' '~'? type)*
func <- 'func' params? ID typeparams? signature block?
signature <- params (params / type)?
params <- '(' (param (',' param)*)? ','? ')'
param <- ID '...' type / ID type / '...'? type
type <- '*' type / '(' type ')' / '[' ']' type / '[' ('...' / expr) ']' type / 'map' '[' type ']' type / chan / 'func' signature / struct / interface / ID ('.' ID)? typeargs?
typeargs <- '[' type (',' type)* ','? ']'
chan <- '<-' 'chan' type / 'chan' '<-'? type
struct <- 'struct' '{{' (field (end field)*)? end? '}}'
field <- (ID (',' ID)* type / '*'? ID ('.' ID)? typeargs?) STR?
interface <- 'interface' '{{' (elem (end elem)*)? end? '}}'
elem <- ID signature / constraint
block <- '{{' stmts '}}'
stmts <- end* (stmt (end+ stmt)*)? end*
stmt <- constvar / typedecl / block / if / for / switch / select / 'return' exprs? / ('break' / 'continue' / 'goto') ID? / 'fallthrough' / ('go' / 'defer') expr / ID ':' !'=' end* stmt? / simple
simple <- exprs (('=' / ':=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^=') exprs / '++' / '--' / '<-' expr)?
if <- 'if' (header end)? header block ('else' (if / block))?
header <- hexprs (('=' / ':=' / '+=' / '-=' / '*=' / '/=') hexprs / '++' / '--' / '<-' hexpr)?
for <- 'for' (forrange / header? end header? end header? / header?) block
forrange <- (hexprs (':=' / '='))? 'range' hexpr
switch <- 'switch' (header? end)? (ID ':=' hexpr / header)? '{{' (end* ('case' (type (',' type)* / exprs) / 'default') ':' stmts)* end* '}}'
select <- 'select' '{{' (end* ('case' simple / 'default') ':' stmts)* end* '}}'
exprs <- expr (',' expr)*
hexprs <- hexpr (',' hexpr)*
expr <- unary (binop unary)*
hexpr <- hunary (binop hunary)*
binop <- '||' / '&&' / '==' / '!=' / '<' / '<=' / '>' / '>=' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '<<' / '>>' / '&' / '&^'
unop <- '+' / '-' / '!' / '^' / '*' / '&' / '<-'
unary <- unop* operand (trailer / literal)*
hunary <- unop* hoperand trailer*
hoperand <- NUM / STR / '(' (expr / type) ')' / 'func' signature block / ID / !('struct' / 'interface') (complex literal) / complex
operand <- NUM / STR / '(' (expr / type) ')' / 'func' signature block / ID / complex
complex <- '[' ('...' / expr)? ']' type / 'map' '[' type ']' type / chan / struct / interface / 'func' signature
trailer <- '.' (ID / '(' ('type' / type) ')') / '[' index ']' / '(' (arg (',' arg)*)? ','? ')'
index <- (expr? ':' expr? (':' expr)?) / (expr / type) (',' (expr / type))* ','?
arg <- (expr / type) '...'?
literal <- '{{' (flat* keyed (',' keyed)*)? ','? '}}'
flat <- (NUM / STR) ',' &(NUM / STR)
keyed <- value (':' value)?
value <- literal / expr
"""


def lex_go(text: str) -> Lexed:
    codes, places, pos, of, last = [], [], 0, GO_CODES.of, ""
    auto, words = of["AUTO"], {w: of[w] for w in GO_KEYWORDS.split()}
    ident = of["ID"]
    while True:
        m = GO_TOKEN.match(text, pos)
        k = m.lastindex
        at = m.start(k)
        if last in GO_ENDS and (k == 6 or text.find("\n", m.start(1), m.end(1)) >= 0):
            codes.append(auto)
            places.append(m.start(1))
        if k == 6:
            break
        if k == 7:
            return "".join(codes) + END, places, at
        last = words.get(m[2], ident) if k == 2 else of["NUM"] if k == 3 else of["STR"] if k == 4 else of[m[5]]
        codes.append(last)
        places.append(at)
        pos = m.end()
    places.append(len(text))
    return "".join(codes) + END, places, None


# ---------------------------------------------------------------- Java
JAVA_KEYWORDS = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
JAVA_NAMES = "var record yield sealed permits non when module open requires exports opens uses provides to with transitive"
JAVA_PUNCT = "( ) { } [ ] ; , . ... @ :: = > < ! ~ ? : -> == <= != && || ++ -- + - * / & | ^ % << += -= *= /= &= |= ^= %= <<="
JAVA_CODES = Codes(["ID", "NUM", "STR"], [*JAVA_KEYWORDS.split(), *JAVA_NAMES.split(), *JAVA_PUNCT.split()])
JAVA_TOKEN = re.compile(
    r"(?:[\s\ufeff\x1a]++|//[^\n\r]*+|/\*(?:[^*]++|\*(?!/))*+\*/)*+(?:((?:[^\W\d]|\$)[\w$]*+)|((?:0[xX][0-9a-fA-F_.]++(?:[pP][+-]?\d++)?+|0[bB][01_]++|\d[\d_]*+(?:\.(?!\.)[\d_]*+)?+(?:[eE][+-]?\d++)?+|\.\d[\d_]*+(?:[eE][+-]?\d++)?+)[lLfFdD]?+(?![\w$]))"
    r"|(\"\"\"[ \t\f]*+\r?\n(?:[^\"\\]++|\\[\s\S]|\"(?!\"\"))*+\"\"\"|\"(?!\"\")(?:[^\"\\\n\r]++|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u++[0-9a-fA-F]{4}))*+\"|\"\"(?!\")|'(?:[^'\\\n\r]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u++[0-9a-fA-F]{4})|[\ud800-\udfff]{2})')|(" + alternatives(JAVA_PUNCT.split()) + r")|(\Z)|())"
)
JAVA = f"""
file <- (annotation* 'package' qualified ';')? (';' / 'import' 'static'? qualified ('.' '*')? ';')* (typedecl / ';')* EOF
name <- ID / {any_of(JAVA_NAMES)}
qualified <- name ('.' name)*
annotation <- '@' !'interface' qualified ('(' (annpair (',' annpair)* / annvalue)? ')')?
annpair <- name '=' annvalue
annvalue <- annotation / '{{' (annvalue (',' annvalue)*)? ','? '}}' / ternary
modifier <- annotation / 'public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !(':' / '->') / 'sealed' &(modword / 'class' / 'interface') / 'non' '-' 'sealed'
modword <- 'public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'strictfp'
typedecl <- modifier* (classdecl / interfacedecl / enumdecl / recorddecl / annodecl)
classdecl <- 'class' name typeparams? ('extends' type)? ('implements' types)? ('permits' types)? classbody
interfacedecl <- 'interface' name typeparams? ('extends' types)? ('permits' types)? classbody
annodecl <- '@' 'interface' name classbody
enumdecl <- 'enum' name ('implements' types)? '{{' (constant (',' constant)*)? ','? (';' member*)? '}}'
constant <- annotation* name args? classbody?
recorddecl <- 'record' name typeparams? '(' (recordpart (',' recordpart)*)? ')' ('implements' types)? classbody
recordpart <- annotation* type '...'? name
classbody <- '{{' member* '}}'
member <- ';' / 'static'? block / modifier* (classdecl / interfacedecl / enumdecl / recorddecl / annodecl / typeparams? (('void' / type) name params dims throws? (block / 'default' annvalue ';' / ';') / name (params throws? block / block)) / type declarators ';')
throws <- 'throws' types
params <- '(' (receiver ','?)? (param (',' param)*)? ')'
receiver <- annotation* type (name '.')* 'this'
param <- ('final' / annotation)* type annotation* '...'? name dims
dims <- (annotation* '[' ']')*
types <- type (',' type)*
type <- annotation* (primitive dims / named dims)
primitive <- 'int' / 'long' / 'boolean' / 'double' / 'char' / 'byte' / 'short' / 'float'
named <- name typeargs? ('.' annotation* name typeargs?)*
typeargs <- '<' (typearg (',' typearg)*)? '>'
typearg <- annotation* '?' (('extends' / 'super') type)? / type
typeparams <- '<' typeparam (',' typeparam)* '>'
typeparam <- annotation* name ('extends' type ('&' type)*)?
declarators <- declarator (',' declarator)*
declarator <- name dims ('=' init)?
init <- '{{' (flat* init (',' init)*)? ','? '}}' / expr
flat <- ('-'? NUM / STR) ',' &('-' / NUM / STR)
block <- '{{' statement* '}}'
statement <- block / ';' / localclass / 'if' '(' expr ')' statement ('else' statement)? / 'for' '(' forhead ')' statement / 'while' '(' expr ')' statement / 'do' statement 'while' '(' expr ')' ';' / try / 'switch' '(' expr ')' switchbody / 'synchronized' '(' expr ')' block / 'return' expr? ';' / 'throw' expr ';' / ('break' / 'continue') name? ';' / 'assert' expr (':' expr)? ';' / 'yield' !('=' / '.' / '(' / '[' / '++' / '--') expr ';' / name ':' statement / local ';' / exprstatement ';'
exprstatement <- &('++' / '--') expr / expr
localclass <- modifier* (classdecl / interfacedecl / enumdecl / recorddecl)
local <- ('final' / annotation)* type declarators
forhead <- ('final' / annotation)* type name ':' expr / (local / expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)?
try <- 'try' (resources block catch* finally? / block (catch+ finally? / finally))
resources <- '(' resource (';' resource)* ';'? ')'
resource <- ('final' / annotation)* type name '=' expr / postfix
catch <- 'catch' '(' ('final' / annotation)* type ('|' type)* name ')' block
finally <- 'finally' block
switchbody <- '{{' (label+ (':' statement* / '->' (block / 'throw' expr ';' / expr ';')))* '}}'
label <- ('case' caselabel (',' caselabel)* ('when' expr)? / 'default') &(':' / '->') (':' &('case' / 'default'))?
caselabel <- 'default' / pattern / ternary
pattern <- ('final' / annotation)* type (name / '(' (pattern (',' pattern)*)? ')' name?)
expr <- lambda / ternary (assignop expr)?
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '&=' / '|=' / '^=' / '%=' / '<<=' / '>' '>' '>'? '='
lambda <- (name / '(' (lparam (',' lparam)*)? ')') '->' (block / expr)
lparam <- ('final' / annotation)* type '...'? name dims / name
ternary <- binary ('?' (lambda / ternary assignrest?) ':' (lambda / ternary))?
assignrest <- assignop expr
binary <- unary (binop unary / 'instanceof' ('final'? pattern / type))*
binop <- '+' / '-' / '*' / '/' / '%' / '&&' / '||' / '==' / '!=' / '<=' / '<<' / '&' / '|' / '^' / '<' / '>' '>' '>'? !'=' / '>' '='?
unary <- ('+' / '-' / '!' / '~' / '++' / '--')* (cast / postfix)
cast <- '(' primitive dims ')' unary / '(' type ('&' type)* ')' (lambda / &(name / STR / NUM / '(' / '!' / '~' / 'this' / 'super' / 'new' / 'true' / 'false' / 'null' / 'switch' / primitive / 'void') unary)
postfix <- (chain / primary) trailer* ('++' / '--')?
chain <- (NUM / STR / 'this' / 'super' / 'true' / 'false' / 'null' / name !'->') ('.' name)*
trailer <- '.' (name / 'new' creator / typeargs (name / 'super') / 'this' / 'super' / 'class') / '[' expr ']' / args / '::' typeargs? (name / 'new')
args <- '(' (expr (',' expr)*)? ')'
primary <- type '::' typeargs? (name / 'new') / '(' expr ')' / 'new' creator / (primitive / 'void') dims '.' 'class' / named dims '.' 'class' / 'switch' '(' expr ')' switchbody
creator <- annotation* typeargs? (primitive / named) (args classbody? / (annotation* '[' expr ']')+ dims / (annotation* '[' ']')+ init)
"""


def lex_java(text: str) -> Lexed:
    codes, places, pos, of = [], [], 0, JAVA_CODES.of
    words = {w: of[w] for w in (JAVA_KEYWORDS + " " + JAVA_NAMES).split()}
    ident, num, string = of["ID"], of["NUM"], of["STR"]
    while True:
        m = JAVA_TOKEN.match(text, pos)
        k = m.lastindex
        if k == 5:
            break
        if k == 6:
            return "".join(codes) + END, places, m.start(6)
        codes.append(words.get(m[1], ident) if k == 1 else num if k == 2 else string if k == 3 else of[m[4]])
        places.append(m.start(k))
        pos = m.end()
    places.append(len(text))
    return "".join(codes) + END, places, None


# ---------------------------------------------------------------- PHP
PHP_KEYWORDS = "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public require require_once return static switch throw trait try unset use var while xor yield readonly enum from exit die self parent true false null"
PHP_SOFT = "enum from readonly self parent true false null match exit die"
PHP_PUNCT = "( ) { } [ ] ; , -> ?-> :: => = == === != !== <> < > <= >= <=> + - * / % ** . ... & | ^ ~ << >> && || ! ? ?? : @ $ ++ -- += -= *= /= .= %= **= &= |= ^= <<= >>= ??= #[ \\"
PHP_CODES = Codes(["ID", "VAR", "NUM", "STR", "HTML"], [*PHP_KEYWORDS.split(), *PHP_PUNCT.split()])
PHP_TOKEN = re.compile(
    r"(?:[\s\ufeff]++|//(?:(?!\?>)[^\n\r])*+|\#(?!\[)(?:(?!\?>)[^\n\r])*+|/\*(?:[^*]++|\*(?!/))*+\*/)*+(?:(\$[^\W\d]\w*+)|(\\?[^\W\d]\w*+(?:\\[^\W\d]\w*+)*+)|((?:0[xX][0-9a-fA-F_]++|0[bB][01_]++|0[oO][0-7_]++|\d[\d_]*+(?:\.(?!\.)[\d_]*+)?+(?:[eE][+-]?\d++)?+|\.\d[\d_]*+(?:[eE][+-]?\d++)?+)(?!\w))"
    r"|([bB]?(?:\"(?:[^\"\\]++|\\[\s\S])*+\"|'(?:[^'\\]++|\\[\s\S])*+')|`(?:[^`\\]++|\\[\s\S])*+`|<<<[ \t]*+(?P<q>[\"']?)(?P<tag>[^\W\d]\w*+)(?P=q)\r?\n(?:(?![ \t]*+(?P=tag)\b)[^\n]*+\n)*+[ \t]*+(?P=tag)\b)|(\?>\n?)|(" + alternatives(PHP_PUNCT.split()) + r")|(\Z)|())"
)
PHP_OPEN = re.compile(r"<\?(?:php(?=[\s\ufeff]|\Z)|=)", re.I)
PHP = f"""
file <- top* EOF
top <- stmt
end <- ';' / &HTML / &EOF
name <- ID / {any_of(PHP_SOFT)} / '\\' ID
word <- ID / {any_of(PHP_KEYWORDS)}
block <- '{{' stmt* '}}'
stmt <- HTML / block / attrs? (function / class) / 'namespace' name (end / block) / 'namespace' block / 'use' useclause end / 'const' const (',' const)* end / if / loop / switch / try / ('break' / 'continue') NUM? end / 'return' expr? end / 'echo' expr (',' expr)* end / 'global' VAR (',' VAR)* end / 'static' VAR ('=' expr)? (',' VAR ('=' expr)?)* end / 'unset' '(' expr (',' expr)* ','? ')' end / 'declare' '(' name '=' expr ')' (end / stmt) / 'goto' ID end / ID ':' / ';' / expr end
useclause <- ('function' / 'const')? usename ('{{' ('function' / 'const')? usename (',' ('function' / 'const')? usename)* ','? '}}')? (',' usename)*
usename <- (name '\\'?) ('as' word)?
const <- word '=' expr
attrs <- ('#[' attr (',' attr)* ','? ']')+
attr <- name args?
function <- 'function' '&'? (word) params (':' type)? block
params <- '(' (param (',' param)*)? ','? ')'
param <- attrs? ('public' / 'private' / 'protected' / 'readonly')* type? '&'? '...'? VAR ('=' expr)?
type <- '?' typeatom / union
union <- typepart (('|' / '&' !('...' / VAR / '&')) typepart)*
typepart <- typeatom / '(' union ')'
typeatom <- name / 'array' / 'callable' / 'static'
class <- ('abstract' / 'final' / 'readonly')* 'class' word ('extends' name)? ('implements' names)? classbody / 'interface' word ('extends' names)? classbody / 'trait' word classbody / 'enum' word (':' type)? ('implements' names)? classbody
names <- name (',' name)*
classbody <- '{{' member* '}}'
member <- 'use' names (';' / '{{' (adapt ';')* '}}') / attrs? 'case' word ('=' expr)? ';' / attrs? modifier* ('const' (type !'=')? const (',' const)* ';' / 'const' const (',' const)* ';' / 'function' '&'? word params (':' type)? (block / ';') / type? VAR ('=' expr)? (',' VAR ('=' expr)?)* ';')
adapt <- name ('::' word)? ('insteadof' names / 'as' modifier? word?)
modifier <- 'public' / 'private' / 'protected' / 'static' / 'abstract' / 'final' / 'var' / 'readonly'
if <- 'if' '(' expr ')' (':' stmt* ('elseif' '(' expr ')' ':' stmt*)* ('else' ':' stmt*)? 'endif' end / stmt ('elseif' '(' expr ')' stmt)* ('else' stmt)?)
loop <- 'while' '(' expr ')' (':' stmt* 'endwhile' end / stmt) / 'do' stmt 'while' '(' expr ')' end / 'for' '(' exprs? ';' exprs? ';' exprs? ')' (':' stmt* 'endfor' end / stmt) / 'foreach' '(' expr 'as' target ('=>' target)? ')' (':' stmt* 'endforeach' end / stmt)
target <- '&'? (unary / 'list' list / array)
exprs <- expr (',' expr)*
switch <- 'switch' '(' expr ')' ('{{' ';'? cases '}}' / ':' cases 'endswitch' end)
cases <- HTML? (('case' expr / 'default') (':' / ';') stmt*)*
try <- 'try' block ('catch' '(' name ('|' name)* VAR? ')' block)* ('finally' block)?
expr <- low (('and' / 'or' / 'xor') low)*
low <- 'yield' ('from' expr / expr ('=>' expr)?)? / 'throw' expr / ('print' / 'include' / 'include_once' / 'require' / 'require_once') expr / ternary
ternary <- binary ('?' expr? ':' binary)*
binary <- unary (binop ('&'? unary / low))*
binop <- '=' / '+=' / '-=' / '*=' / '/=' / '.=' / '%=' / '**=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '??=' / '==' / '===' / '!=' / '!==' / '<>' / '<' / '>' / '<=' / '>=' / '<=>' / '+' / '-' / '*' / '/' / '%' / '**' / '.' / '&' / '|' / '^' / '<<' / '>>' / '&&' / '||' / '??' / 'instanceof'
prefix <- '!' / '-' / '+' / '~' / '@' / '&' / '++' / '--' / 'clone' / '(' castname ')'
castname <- ID !'(' &')'
unary <- prefix* postfix
postfix <- (simple / primary) trailer* ('++' / '--')?
simple <- VAR ('->' (ID / VAR))* / NUM / STR
trailer <- ('->' / '?->') (word / VAR / '{{' expr '}}' / '$' VAR) / '::' ('class' / word / VAR / '{{' expr '}}' / '$' VAR) / '[' expr? ']' / args / '{{' NUM '}}'
args <- '(' '...' ')' / '(' (arg (',' arg)*)? ','? ')'
arg <- '...' expr / word ':' !':' expr / expr
primary <- '(' expr ')' / array / 'array' '(' items? ')' / 'list' list / 'isset' '(' expr (',' expr)* ','? ')' / 'empty' '(' expr ')' / ('exit' / 'die') ('(' expr? ')')? / closure / 'new' newbody / 'match' '(' expr ')' '{{' (arm (',' arm)*)? ','? '}}' / 'static' &'::' / 'static' closure / '$' ('{{' expr '}}' / primary / VAR) / name / 'fn' / 'namespace' '\\' ID
array <- '[' items? ']'
list <- '(' items? ')'
items <- flat* ','* (item (','+ item)*)? ','*
flat <- ('-'? NUM / STR) ','
item <- '...' expr / '&' unary / expr ('=>' '&'? expr)?
arm <- ('default' ','? / expr (',' expr)* ','?) '=>' expr
closure <- attrs? 'static'? ('function' '&'? params ('use' '(' ('&'? VAR (',' '&'? VAR)*)? ','? ')')? (':' type)? block / 'fn' '&'? params (':' type)? '=>' expr)
newbody <- attrs? 'readonly'? 'class' args? ('extends' name)? ('implements' names)? classbody / ('static' / name / newtarget) args?
newtarget <- VAR (('->' / '::') (ID / VAR) / '[' expr ']')* / '(' expr ')'
"""


def lex_php(text: str) -> Lexed:
    codes, places, of = [], [], PHP_CODES.of
    words = {w: of[w] for w in PHP_KEYWORDS.split()}
    m = PHP_OPEN.search(text)
    if not m:
        return of["HTML"] + END, [0, len(text)], None
    if text[: m.start()].strip("\ufeff"):
        codes.append(of["HTML"])
        places.append(0)
    if m[0].endswith("="):
        codes.append(of["echo"])
        places.append(m.start())
    pos = m.end()
    while True:
        m = PHP_TOKEN.match(text, pos)
        k = m.lastindex if m["tag"] is None else 4
        if k == 9:
            break
        if k == 10:
            return "".join(codes) + END, places, m.start(10)
        at = m.start(k)
        if k == 7:  # closing tag: what follows is text up to the next opening tag
            codes.append(of[";"] if codes and codes[-1] not in (of[";"], of["{"], of["}"], of[":"], of["HTML"]) else of["HTML"])
            places.append(at)
            o = PHP_OPEN.search(text, m.end())
            codes.append(of["HTML"])
            places.append(m.end())
            if not o:
                break
            if o[0].endswith("="):
                codes.append(of["echo"])
                places.append(o.start())
            pos = o.end()
            continue
        if k == 1:
            code = of["VAR"]
        elif k == 2:
            code = words.get(m[2].lower(), of["ID"])
        elif k == 3:
            code = of["NUM"]
        elif k == 4:
            code = of["STR"]
        else:
            code = of[m[8]]
        codes.append(code)
        places.append(at)
        pos = m.end()
    places.append(len(text))
    return "".join(codes) + END, places, None


# ---------------------------------------------------------------- Python
PY_KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
PY_SOFT = "match case type _"
PY_PUNCT = "( ) [ ] { } , : := ; . ... -> = == != < > <= >= + - * / // % @ & | ^ ~ << >> ** += -= *= /= //= %= @= &= |= ^= >>= <<= **="
PY_CODES = Codes(["ID", "NUM", "STR", "NEWLINE", "INDENT", "DEDENT"], [*PY_KEYWORDS.split(), *PY_SOFT.split(), *PY_PUNCT.split()])
PY_STRING = (
    r"(?:[rR][bB]?|[bB][rR]?|[uU]|[fF][rR]?|[rR][fF])?(?:\"\"\"(?:[^\"\\]++|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|\"(?!\"\")(?:[^\"\\\n\r]++|\\(?:\r\n|[\s\S]))*+\"|'(?!'')(?:[^'\\\n\r]++|\\(?:\r\n|[\s\S]))*+'|\"\"(?!\")|''(?!'))"
)
PY_TOKEN = re.compile(
    r"(?:[ \t\f]++|\\\r?\n)*+(?:(" + PY_STRING + r")|([^\W\d]\w*+)|((?:0[xX](?:_?[0-9a-fA-F])++|0[oO](?:_?[0-7])++|0[bB](?:_?[01])++|(?:(?:\d(?:_?\d)*+)?\.\d(?:_?\d)*+|\d(?:_?\d)*+\.?)(?:[eE][+-]?\d(?:_?\d)*+)?+[jJ]?)(?![^\W_]|_))|(#[^\n]*+)|(\r?\n|\r)|(" + alternatives(PY_PUNCT.split()) + r")|(\Z)|())"
)
PY_ZERO = re.compile(r"0[0_]*[1-9]\d*$")
PY = f"""
file <- NEWLINE* stmt* EOF
name <- ID / {any_of(PY_SOFT)}
block <- NEWLINE INDENT stmt+ DEDENT / simples
stmt <- compound / simples / NEWLINE
simples <- simple (';' simple)* ';'? NEWLINE
simple <- 'pass' / 'break' / 'continue' / 'return' starexprs? / 'raise' (expr ('from' expr)?)? / ('global' / 'nonlocal') name (',' name)* / 'del' targets / 'assert' expr (',' expr)? / import / typealias / assignment
typealias <- 'type' name typeparams? '=' expr
typeparams <- '[' typeparam (',' typeparam)* ','? ']'
typeparam <- ('*' / '**')? name (':' expr)? ('=' starexpr)?
import <- 'import' dotted ('as' name)? (',' dotted ('as' name)?)* / 'from' ('.' / '...')* (dotted 'import' / 'import') ('*' / '(' alias (',' alias)* ','? ')' / alias (',' alias)*)
dotted <- name ('.' name)*
alias <- name ('as' name)?
targets <- target (',' target)* ','?
target <- '(' targets? ')' !trailerahead / '[' targets? ']' !trailerahead / lhspost
assignment <- !(literal '=') (lhspost / '(' lhspost ')') ':' expr ('=' (yield / starexprs))? / lhspost augment (yield / starexprs) / (assignable '=')+ (yield / starexprs) / yield / starexprs
assignable <- starred (',' starred)* ','? &'='
starred <- '*'? lhs
lhs <- '(' (starred (',' starred)* ','?)? ')' !trailerahead / '[' (starred (',' starred)* ','?)? ']' !trailerahead / lhspost
lhspost <- name !trailerahead / !(literal !trailerahead) atom (step &trailerahead)* place
step <- '.' name / '[' slices ']' / '(' args? ')'
place <- '.' name / '[' slices ']'
trailerahead <- '.' / '[' / '('
literal <- ('None' / 'True' / 'False' / NUM / STR+ / '...') !('.' / '[' / '(')
augment <- '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
compound <- decorated / function / class / if / for / while / try / with / match
decorated <- ('@' named NEWLINE)+ (function / class)
function <- 'async'? 'def' name typeparams? '(' params? ')' ('->' expr)? ':' block
params <- param (',' param)* ','?
param <- '/' / '**' name (':' expr)? / '*' name (':' starexpr)? / '*' &',' / name (':' expr)? ('=' expr)?
class <- 'class' name typeparams? ('(' args? ')')? ':' block
if <- 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
for <- 'async'? 'for' loopvars 'in' starexprs ':' block ('else' ':' block)?
loopvars <- loopvar (',' loopvar)* ','?
loopvar <- '*'? ('(' loopvars? ')' !trailerahead / '[' loopvars? ']' !trailerahead / lhspost)
while <- 'while' named ':' block ('else' ':' block)?
try <- 'try' ':' block (('except' '*'? (expr (',' expr)* ('as' name)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? / 'finally' ':' block)
with <- 'async'? 'with' ('(' withitem (',' withitem)* ','? ')' ':' block / withitem (',' withitem)* ':' block)
withitem <- expr ('as' target)?
match <- 'match' subject ':' NEWLINE INDENT case+ DEDENT
subject <- named (',' named)* ','? / '*' expr ',' (named (',' named)* ','?)?
case <- 'case' patterns ('if' named)? ':' block
patterns <- pattern (',' pattern)* ','?
pattern <- '*'? orpattern ('as' name)?
orpattern <- patternatom ('|' patternatom)*
patternatom <- '-'? NUM (('+' / '-') NUM)? / STR+ / 'None' / 'True' / 'False' / '(' patterns? ')' / '[' patterns? ']' / '{{' (mapitem (',' mapitem)* ','?)? '}}' / dotted ('(' (patternarg (',' patternarg)* ','?)? ')')?
patternarg <- name '=' pattern / pattern
mapitem <- '**' name / ('-'? NUM (('+' / '-') NUM)? / STR+ / 'None' / 'True' / 'False' / dotted) ':' pattern
yield <- 'yield' ('from' expr / starexprs)?
starexprs <- starexpr (',' starexpr)* ','?
starexpr <- '*' bits / named
named <- name ':=' expr / expr
expr <- quick &(',' / ')' / NEWLINE / ']' / ':' / '}}') / lambda / or ('if' or 'else' expr)?
quick <- NUM / STR / name ('.' name)*
lambda <- 'lambda' lparams? ':' expr
lparams <- lparam (',' lparam)* ','?
lparam <- '/' / '**' name / '*' name / '*' &',' / name ('=' expr)?
or <- not (('and' / 'or') not)*
not <- 'not'* compare
compare <- bits (compop bits)*
compop <- '<' / '>' / '==' / '>=' / '<=' / '!=' / 'not' 'in' / 'in' / 'is' 'not' / 'is'
bits <- factor (('|' / '^' / '&' / '<<' / '>>' / '+' / '-' / '*' / '/' / '//' / '%' / '@' / '**') factor)*
factor <- ('+' / '-' / '~')* 'await'? postfix
postfix <- atom trailer*
trailer <- ('.' name)+ / '(' args? ')' / '[' slices ']'
slices <- slice (',' slice)* ','?
slice <- named? ':' expr? (':' expr?)? / '*' bits / named
args <- arg (',' arg)* ','?
arg <- '**' expr / '*' expr / name '=' expr / named comp*
comp <- 'async'? 'for' loopvars 'in' or ('if' (named / lambda) )*
atom <- name / NUM / STR+ / 'None' / 'True' / 'False' / '...' / '(' (yield / named comp+ / starexprs)? ')' / '[' (named comp+ / flat* starexprs / flat+)? ']' / '{{' (dictitem comp+ / dictitem (',' dictitem)* ','? / named comp+ / starexprs)? '}}'
flat <- ('-'? NUM / STR) ','
dictitem <- '**' bits / expr ':' expr
"""


def lex_python(text: str) -> Lexed:
    codes, places, pos, of = [], [], 1 if text.startswith("\ufeff") else 0, PY_CODES.of
    words = {w: of[w] for w in (PY_KEYWORDS + " " + PY_SOFT).split()}
    ident, num, string, newline = of["ID"], of["NUM"], of["STR"], of["NEWLINE"]
    opens, closes = "([{", ")]}"
    stack: list[str] = []
    indents = [(0, 0)]  # columns with tabs to 8 and to 1, to find tabs and blanks that disagree
    fresh, n = True, len(text)
    blank = re.compile(r"([ \t\f]*+)(?:#[^\n\r]*+)?(?:\r?\n|\r|\Z)")
    lead = re.compile(r"[ \t\f]*+")
    while True:
        if fresh and not stack:
            while pos < n and (m := blank.match(text, pos)) and m.end() > pos:
                pos = m.end()
            m = lead.match(text, pos)
            space = m[0].rpartition("\f")[2]
            wide, narrow = len(space.expandtabs(8)), len(space)
            at = m.end()
            if at >= n:
                wide = narrow = 0
            if wide > indents[-1][0]:
                if narrow <= indents[-1][1]:
                    return "".join(codes) + END, places, at
                indents.append((wide, narrow))
                codes.append(of["INDENT"])
                places.append(at)
            else:
                while wide < indents[-1][0]:
                    indents.pop()
                    codes.append(of["DEDENT"])
                    places.append(at)
                if wide != indents[-1][0] or narrow != indents[-1][1]:
                    return "".join(codes) + END, places, at
            fresh = False
            pos = at
            if at >= n:
                break
        m = PY_TOKEN.match(text, pos)
        k = m.lastindex
        at = m.start(k)
        if k == 8:
            return "".join(codes) + END, places, at
        pos = m.end()
        if k == 4:
            continue
        if k == 5:
            if stack:
                continue
            codes.append(newline)
            places.append(at)
            fresh = True
            continue
        if k == 7:
            if stack:
                return "".join(codes) + END, places, at
            if codes and codes[-1] not in (newline, of["DEDENT"]):
                codes.append(newline)
                places.append(at)
            for _ in indents[1:]:
                codes.append(of["DEDENT"])
                places.append(at)
            break
        if k == 2:
            code = words.get(m[2], ident)
        elif k == 1:
            code = string
        elif k == 3:
            if PY_ZERO.match(m[3]):
                return "".join(codes) + END, places, at
            code = num
        else:
            mark = m[6]
            code = of[mark]
            if mark in opens:
                stack.append(mark)
            elif mark in closes:
                if not stack or opens[closes.index(mark)] != stack.pop():
                    codes.append(code)
                    places.append(at)
                    return "".join(codes) + END, places, at
        codes.append(code)
        places.append(at)
    places.append(n)
    return "".join(codes) + END, places, None


SOURCES: dict[str, tuple[Callable[[str], Lexed], Callable[[], Grammar]]] = {
    "py": (lex_python, lambda: Grammar(PY, PY_CODES)),
    "js": (lex_script, lambda: Grammar(script_grammar(False), SCRIPT_CODES)),
    "ts": (lex_script, lambda: Grammar(script_grammar(True), SCRIPT_CODES)),
    "go": (lex_go, lambda: Grammar(GO, GO_CODES)),
    "java": (lex_java, lambda: Grammar(JAVA, JAVA_CODES)),
    "php": (lex_php, lambda: Grammar(PHP, PHP_CODES)),
    "json": (lex_json, lambda: Grammar(JSON, JSON_CODES)),
}
