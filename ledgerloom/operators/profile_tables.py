"""Fixed values of the rule registry, the profiles and the compatibility analysis."""

from __future__ import annotations

# fixed values: rules that every profile has, by output
BUILTIN_RULES = {
    "InlineText": "textbf textit texttt textsf emph mathbf mathrm mathsf mathtt underline sout xout uwave CJKfamily CJKunderline".split(),
    "Ignore": "tiny small large Large LARGE huge Huge hspace vspace quad qquad smallskip bigskip newline newpage pagebreak nopagebreak clearpage cleardoublepage".split(),
    "Heading": "paragraph subparagraph".split(),
}
# fixed values: rules of journals, (profiles, {output: names with their number of arguments})
JOURNAL_RULES = [
    (
        ["jos-paper", "jos-paper-toml"],
        {
            "AuthorList": "IEEEauthorblockN/1",
            "Affiliation": "IEEEauthorblockA/1",
            "KeywordList": "IEEEkeywords/1",
            "MetadataField": "markboth/2 IEEEpeerreviewmaketitle/0",
            "Citation": "citet/1 citep/1"
        }
    ),
    (
        ["tacl", "acl"],
        {"MetadataField": "aclfinalcopy/0 aclpaperid/0 shorttitle/1", "Citation": "citet/1 citep/1 citealp/1", "AuthorList": "name/1", "Affiliation": "address/1"}
    ),
    (
        ["cvpr", "iccv"],
        {"MetadataField": "cvprfinalcopy/0 iccvfinalcopy/0 cvprPaperID/1 confName/1 confYear/1", "AuthorList": "author/1", "Affiliation": "affiliation/1"}
    ),
    (["nature"], {"MetadataField": "corres/0 equalcont/0", "Affiliation": "affil/1", "Ignore": "maketitle/0"}),
    (["springer", "svjour3", "llncs"], {"Affiliation": "institute/1", "MetadataField": "titlerunning/1 authorrunning/1 email/1 orcidID/1", "KeywordList": "keywords/1"}),
    (
        ["chinese-academic", "chinese-academic-toml"],
        {"Ignore": "zihao/1 songti/0 heiti/0 kaishu/0 fangsong/0 CTEXsetup/2 ctexset/1", "KeywordList": "keywords/1", "MetadataField": "zhabstract/1 enabstract/1"}
    ),
]
# fixed values: what a profile file calls an output
SEMANTICS = {
    "citation": "Citation",
    "metadata": "MetadataField",
    "author": "AuthorList",
    "affiliation": "Affiliation",
    "keyword": "KeywordList",
    "heading": "Heading",
    "paragraph": "Paragraph",
    "inline-text": "InlineText",
    "ignore": "Ignore",
    "verbatim": "Verbatim"
}
# fixed values: signals of the profiles: kind, value, weight
SIGNALS = {
    "chinese-academic": [("documentclass", "ctexart", 0.70), ("package", "ctex", 0.10), ("package", "xeCJK", 0.05), ("macro", "setCJKmainfont", 0.05)],
    "cvpr": [
        ("documentclass", "IEEEtran", 0.70),
        ("documentclass_option", "conference", 0.20),
        ("macro", "cvprfinalcopy", 0.10),
        ("macro", "iccvfinalcopy", 0.10),
        ("macro", "cvprPaperID", 0.05)
    ],
    "jos-paper": [("documentclass", "rjthesis", 0.80)],
    "jos-paper-toml": [
        ("documentclass", "IEEEtran", 0.70),
        ("documentclass_option", "journal", 0.20),
        ("macro", "IEEEauthorblockN", 0.10),
        ("macro", "IEEEkeywords", 0.05)
    ],
    "nature": [("documentclass", "nature", 0.70), ("bibliographystyle", "naturemag", 0.15), ("macro", "corres", 0.10)],
    "springer": [
        ("documentclass", "springer", 0.70),
        ("macro", "institute", 0.10),
        ("macro", "titlerunning", 0.05),
        ("macro", "authorrunning", 0.05),
        ("documentclass", "svjour3", 0.70),
        ("documentclass", "llncs", 0.70)
    ],
    "tacl": [("documentclass", "acl", 0.70), ("documentclass_option", "aclang", 0.20), ("macro", "aclfinalcopy", 0.10), ("package", "natbib", 0.05)],
}
MIN_CONFIDENCE = 0.75
# fixed values: macros that count as signals
SIGNAL_MACROS = (
    "IEEEauthorblockN IEEEauthorblockA IEEEkeywords IEEEpeerreviewmaketitle cvprfinalcopy iccvfinalcopy cvprPaperID aclfinalcopy aclpaperid shorttitle "
    "corres equalcont affil institute titlerunning authorrunning orcidID setCJKmainfont zhabstract enabstract ctexset"
).split()
# fixed values: issues of any profile: kind, name, code, U(nsupported) or W(arning)
ISSUES = (
    [
        ("environment", "tikzpicture", "unsupported_environment", "U"),
        ("environment", "minted", "unsupported_environment", "U"),
        ("environment", "lstlisting", "limited_environment", "W")
    ]
    + [("class", n, "unsupported_document_class", "U") for n in ("beamer", "standalone")]
    + [("package", n, "unsupported_package", "U") for n in ("tikz", "pgf", "pgfplots", "circuitikz", "pstricks", "minted")]
    + [("package", n, "limited_package", "W") for n in ("listings", "biblatex", "longtable", "tabularx", "tabulary", "algorithm2e", "algorithmicx", "algpseudocode")]
)
#: Those that a laxer rule set only warns of, and by which switch.
LENIENT = {"tikz": ["tikzpicture", "tikz", "pgf", "pgfplots", "circuitikz"], "minted_package": ["minted"]}
# fixed values: packages a profile limits or doesn't support
PROFILE_PACKAGES = [
    ("jos-paper", "algorithm2e", "W"), ("jos-paper", "tabularx", "W"), ("tacl", "biblatex", "W"), ("tacl", "tikz", "W"), ("cvpr", "algorithmicx", "W"), ("cvpr", "subcaption", "W"),
    ("nature", "biblatex", "W"), ("nature", "pstricks", "U"), ("springer", "algorithm2e", "W"), ("springer", "longtable", "W"), ("springer", "beamer", "U"),
    ("chinese-academic", "gbt7714", "W"), ("chinese-academic", "biblatex", "W"), ("chinese-academic", "minted", "U"),
]
# fixed values: classes a profile takes; profiles without an entry take any
PROFILE_CLASSES = {
    "chinese-academic": ["article", "report", "book", "ctexart", "ctexbook", "ctexrep"],
    "jos-paper": ["article", "rjthesis"],
    "tacl": ["acl"],
    "cvpr": ["IEEEtran"],
    "nature": ["nature"],
    "springer": ["springer", "svjour3", "llncs", "sn-jnl"],
    "medical-journal": ["article", "elsarticle", "wlscirep"],
}


def builtin_rows() -> list[tuple[str, str]]:
    """(name, output)."""
    return [(name, output) for output, names in BUILTIN_RULES.items() for name in names]


def journal_rows() -> list[tuple[str, str, int, str]]:
    """(profile_id, name, arity, output)."""
    return [
        (p, n.split("/")[0], int(n.split("/")[1]), output) for profiles,
        rules in JOURNAL_RULES for output,
        names in rules.items() for n in names.split() for p in profiles
    ]
