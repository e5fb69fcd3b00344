"""What the bracket reader must know of each language; a language is added by a row of this table."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Grammar:
    """Tables of one language; all of them plain words and marks."""

    #: Begin a comment that ends with its line.
    line_comments: tuple[str, ...] = ("//",)
    block_comments: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    #: Quotes in which a backslash takes the next character along; raw ones have none.
    quotes: str = "\"'"
    raw_quotes: str = ""
    #: A quote whose text holds code between ${ and }.
    template: str = ""
    #: Letters and marks that a name may begin with besides a letter.
    name_marks: str = "_"
    #: Marks that go on with what stands before them.
    links: tuple[str, ...] = (".",)
    #: Words that declare a function, and those that declare a variable.
    functions: frozenset[str] = frozenset()
    declares: frozenset[str] = frozenset()
    #: Functions are written as a name, brackets and a block.
    plain_functions: bool = True
    #: => begins a function's body; functions without a name are functions too.
    arrows: bool = False
    #: Marks that assign.
    assigns: frozenset[str] = frozenset(["="])
    #: Several names stand to the left of one mark.
    lists: bool = False
    #: Expressions end with their line.
    lines: bool = False
    #: A line that begins with one of these goes on with the last.
    continues: frozenset[str] = frozenset()
    #: Words at which an expression ends.
    ends: frozenset[str] = frozenset()
    #: A statement that begins with one of these is an import.
    imports: frozenset[str] = frozenset(["import"])
    #: Not calls, though brackets follow, and not names.
    words: frozenset[str] = frozenset()
    #: A slash may begin a pattern.
    patterns: bool = False
    #: Code stands between these marks where the text holds the first one.
    inside: tuple[str, str] | None = None


_COMMON = frozenset("if else for while do switch case default catch try finally return throw new break continue true false null".split())
_COMPOUND = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="])
_OPERATORS = frozenset([".", "?.", "+", "-", "*", "/", "%", "&&", "||", "??", "?", ":", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "=", ",", ")", "]", "}"])
_SCRIPT = Grammar(
    template="`", name_marks="_$", links=(".", "?."), functions=frozenset(["function"]), declares=frozenset(["const", "let", "var"]), arrows=True, lines=True, continues=_OPERATORS, patterns=True,
    words=_COMMON | frozenset("typeof instanceof in of delete void await async yield this super function class extends export as const let var undefined".split()),
)
GRAMMARS: dict[str, Grammar] = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "go": Grammar(
        raw_quotes="`", functions=frozenset(["func"]), declares=frozenset(["var", "const"]), plain_functions=False, assigns=_COMPOUND | {":="}, lists=True, lines=True,
        words=(_COMMON - {"null", "new"}) | frozenset("func go defer select range chan map struct interface type package nil var const".split()),
    ),
    "java": Grammar(
        functions=frozenset(["fun"]), declares=frozenset(["val", "var"]), assigns=_COMPOUND,
        words=_COMMON | frozenset("instanceof synchronized this super class extends implements throws public private protected static final void assert fun val var when is in as".split()),
    ),
    "rust": Grammar(
        quotes='"', links=(".", "::"), functions=frozenset(["fn"]), declares=frozenset(["let"]), plain_functions=False, assigns=frozenset(["="]), imports=frozenset(["use"]),
        words=(_COMMON - {"new", "null", "default"}) | frozenset("fn let mut match loop impl struct enum trait pub mod use where as in ref move unsafe self super crate const static dyn".split()),
    ),
    "php": Grammar(
        line_comments=("//", "#"), name_marks="_$\\", links=("->", "?->", "::"), functions=frozenset(["function"]), plain_functions=False, imports=frozenset("use require require_once include include_once".split()),
        words=_COMMON | frozenset("elseif foreach as echo print function fn class extends public private protected static use namespace instanceof global isset empty unset array list and or".split()), inside=("<?", "?>"),
    ),
    "c": Grammar(
        links=(".", "->"), assigns=_COMPOUND, imports=frozenset(["#include"]), name_marks="_#",
        words=_COMMON | frozenset("sizeof struct enum union typedef static const extern void goto #define #if #ifdef #ifndef #endif #else #pragma".split()),
    ),
    "csharp": Grammar(
        name_marks="_@", links=(".", "?."), assigns=_COMPOUND, declares=frozenset(["var"]), imports=frozenset(["using"]),
        words=_COMMON | frozenset("foreach lock using is as typeof nameof sizeof this base class struct public private protected internal static void where await async in out ref get set when fixed checked unchecked".split()),
    ),
}
GRAMMARS["cpp"] = Grammar(**{**GRAMMARS["c"].__dict__, "links": (".", "->", "::"), "words": GRAMMARS["c"].words | frozenset("class namespace template typename public private protected virtual override delete using operator throw decltype alignof catch".split())})


#: Words of Ruby: what opens a block, wherever it stands or at the beginning of a statement only, and what a command's arguments end at.
OPENS_BLOCK, OPENS_BLOCK_FIRST = frozenset("do begin class module def case".split()), frozenset("if unless while until for".split())
AFTER_COMMAND = frozenset("if unless while until do end then and or rescue".split())
GRAMMARS["ruby"] = Grammar(
    line_comments=("#",), block_comments=(("=begin\n", "\n=end"),), quotes="\"'`", name_marks="_@$", links=(".", "::", "&."), plain_functions=False, assigns=frozenset(["=", "||=", "+="]), lines=True, ends=AFTER_COMMAND, continues=frozenset([".", "&.", "&&", "||"]),
    imports=frozenset("require require_relative".split()),
    words=frozenset("if unless while until for do begin end class module def case when then else elsif rescue ensure return yield self nil true false and or not in".split()),
)
#: Words of a shell that are no commands.
SHELL_WORDS = frozenset("if then elif else fi for in do done while until case esac function select time !".split())
SHELL_IMPORTS = frozenset(["source", "."])
