"""Small helpers of reports: durations, names of outputs and texts without private values."""

from __future__ import annotations


def duration(seconds: float, template: str | None = None) -> str:
    """Seconds in a fitting unit, or by a template of %H, %M and %S."""
    if template:
        whole = int(seconds)
        parts = {"%H": whole // 3600, "%M": whole % 3600 // 60, "%S": whole % 60}
        for mark, value in parts.items():
            template = template.replace(mark, str(value))
        return template
    for least, unit, digits in ((3600, "h", 1), (60, "m", 1), (1, "s", 2), (1e-3, "ms", 2), (1e-6, "μs", 2)):
        if seconds >= least:
            return f"{seconds / least:.{digits}f}{unit}"
    return f"{seconds * 1e9:.0f}ns"


def output_name(template: str, **values: str) -> str:
    """A template's name with one .tsv at most at its end."""
    name = template.format(**values)
    while name.endswith(".tsv.tsv"):
        name = name[:-4]
    return name


def scrubbed(text: str, private: dict[str, str]) -> str:
    """text with private values replaced by the names of what they are, the longest first."""
    for value, name in sorted(private.items(), key=lambda x: -len(x[0])):
        if value:
            text = text.replace(value, f"<{name}>")
    return text
