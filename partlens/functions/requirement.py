"""What is asked for: a requirement, built from words and numbers as users write them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from . import vocabulary as V


def numbers_in(text: str | None) -> list[float]:
    return [float(x) for x in re.findall(r"\d+(?:\.\d+)?", text or "")]


def band(text: str | None) -> tuple[float, float] | None:
    """Two numbers are a band in order, one is a band from 0; words between them don't matter."""
    found = numbers_in(text)[:2]
    return None if not found else (0.0, found[0]) if len(found) == 1 else (min(found), max(found))


def impedance(text: object) -> float | None:
    found = numbers_in(None if text is None else str(text))
    return found[0] if found else None


def space_word(value: str | None) -> str | None:
    """How space qualification is asked for: space_qualified, space_grade, any-space, none; other words as they are."""
    if not value:
        return None
    v = value.strip().lower().replace("-", "_")
    same = {"qualified": "space_qualified", "qual": "space_qualified", "grade": "space_grade", "any": "any-space", "any_space": "any-space", "anyspace": "any-space"}
    return same.get(v, v)


@dataclass(frozen=True)
class Requirement:
    """Criteria of a search; what is None isn't asked for."""

    category: str | None = None
    subcategory: str | None = None
    subcategory_terms: tuple[str, ...] = ()
    freq_ghz: tuple[float, float] | None = None
    cutoff_ghz: float | None = None
    filter_response: str | None = None
    stopband_ghz: tuple[float, float] | None = None
    temp_k: float | None = None
    gain_db_min: float | None = None
    noise_k_max: float | None = None
    attenuation_db: float | None = None
    impedance_ohm: float | None = None
    ports: int | None = None
    connector: str | None = None
    mount: str | None = None
    package: str | None = None
    space: bool = False
    max_lead_weeks: float | None = None
    prefer_vendors: tuple[str, ...] = ()
    exclude_vendors: tuple[str, ...] = ()
    local_only: bool = True
    #: Declared specifications by the requirement's name, e.g. nf_db_max.
    specs: dict[str, object] = field(default_factory=dict)


def built(freq: str | None = None, impedance_ohm: object = None, **asked) -> Requirement:
    """From words as users write them: categories and packages by any of their names, bands by text, names in the usual case."""
    known = {k: v for k, v in asked.items() if v is not None}
    specs = {k: v for k, v in known.items() if k in {wanted for _, wanted, *_ in V.SPECS}}
    own = {k: v for k, v in known.items() if k not in specs}
    if "ports" in own:
        try:
            own["ports"] = int(own["ports"])
        except (TypeError, ValueError):
            del own["ports"]
    tidy = {"category": V.category_of, "package": V.package_of, "connector": lambda x: x.upper().replace(" ", ""), "mount": str.lower, "prefer_vendors": tuple, "exclude_vendors": tuple, "subcategory_terms": tuple}
    own = {k: tidy[k](v) if k in tidy else v for k, v in own.items()}
    return Requirement(freq_ghz=band(freq), impedance_ohm=impedance(impedance_ohm), specs=specs, **own)


def by_response(asked: Requirement, response: str, target: float | None = None) -> Requirement:
    """A filter's response: low and high passes are asked for by their cutoff instead of a band, a band stop by its stop band."""
    if response in ("lowpass", "highpass"):
        edge = target if target is not None else asked.freq_ghz and asked.freq_ghz[response == "lowpass"]
        return replace(asked, freq_ghz=None, cutoff_ghz=edge, filter_response=response)
    if response == "bandstop":
        return replace(asked, stopband_ghz=asked.freq_ghz, filter_response=response)
    return replace(asked, filter_response=response)
