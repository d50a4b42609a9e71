"""Driver-side rendering of small report tables."""

from __future__ import annotations

import re

#: Characters that LaTeX reads as commands.
ESCAPES = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def tex(text: str) -> str:
    """A cell: `code`, **bold** and *emphasis* become commands, the rest is escaped."""
    plain = lambda t: "".join(ESCAPES.get(c, c) for c in t)

    def words(t: str) -> str:
        t = re.sub(r"\*\*(.+?)\*\*", r"\\textbf{\1}", plain(t))
        return re.sub(r"\*(\S(?:.*?\S)?)\*", r"\\emph{\1}", t)

    return "".join(rf"\texttt{{{plain(p)}}}" if i % 2 else words(p) for i, p in enumerate(text.strip().split("`")))


def latex(markdown: str, label: str) -> str:
    """The one pipe table of a text as a LaTeX float: prose above is the caption, prose below a note. A ragged row is an error."""
    lines = markdown.splitlines()
    at = [i for i, line in enumerate(lines) if line.lstrip().startswith("|")]
    if len(at) < 3:
        raise ValueError(f"{label}: no table")
    cells = lambda line: [c.strip() for c in line.strip().strip("|").split("|")]
    head, rule, *body = [cells(lines[i]) for i in at]
    for k, row in enumerate(body):
        if len(row) != len(head):
            raise ValueError(f"{label}: row {k} has {len(row)} cells, the header {len(head)}")
    side = "".join("c" if r.startswith(":") and r.endswith(":") else "r" if r.endswith(":") else "l" for r in rule)
    above = tex(" ".join(line.lstrip("# ").strip() for line in lines[: at[0]] if line.strip()))
    below = tex(" ".join(line.strip() for line in lines[at[-1] + 1 :] if line.strip()))
    rows = [" & ".join(map(tex, r)) + r" \\" for r in (head, *body)]
    note = [rf"\par {below}"] if below else []
    return "\n".join([r"\begin{table}", r"\centering", rf"\caption{{{above}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{side}}}", rows[0], r"\hline", *rows[1:], r"\end{tabular}", *note, r"\end{table}"])


def run_names(directory: str) -> tuple[str, str]:
    """Names of a run's table and analysis, from its folder, so that two runs don't share files."""
    name = re.sub(r"[^A-Za-z0-9]+", "_", directory.rstrip("/").rsplit("/", 1)[-1]).strip("_") or "run"
    return f"{name}.csv", f"{name}_analysis.md"
