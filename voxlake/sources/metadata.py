"""Multiscale image metadata: built, checked, and kept as a JSON file beside the data."""

from __future__ import annotations

KNOWN_AXES = {"t": "time", "c": "channel", "z": "space", "y": "space", "x": "space"}


def checked_axes(axes: str | list | None, ndim: int) -> list[dict]:
    """Axis descriptions; only two and five dimensions can be guessed."""
    if axes is None:
        if ndim not in (2, 5):
            raise ValueError(f"axes of {ndim} dimensions cannot be guessed")
        axes = "tczyx"[-ndim:]
    out = [a if isinstance(a, dict) else {"name": a, "type": KNOWN_AXES.get(a, "space")} for a in axes]
    if len(out) != ndim:
        raise ValueError(f"{len(out)} axes for {ndim} dimensions")
    if len({a["name"] for a in out}) != ndim:
        raise ValueError("axis names repeat")
    kinds = [a.get("type") for a in out]
    space = kinds.count("space")
    if not 2 <= space <= 3 or kinds[-space:] != ["space"] * space:
        raise ValueError("two or three space axes must come last")
    if kinds.count("time") > 1 or kinds.count("channel") > 1:
        raise ValueError("time and channel occur once at most")
    return out


def default_axes(ndim: int) -> str:
    return "czyx"[-ndim:]


def level_scales(ndim: int, levels: int) -> list[list[dict]]:
    """Coordinate transformations of levels 0 to levels: twice as coarse each along the last two axes."""
    return [[{"type": "scale", "scale": [1.0] * (ndim - 2) + [float(2**k)] * 2}] for k in range(levels + 1)]


def checked_datasets(datasets: list[dict], ndim: int) -> list[dict]:
    if not datasets:
        raise ValueError("no datasets")
    for d in datasets:
        if not isinstance(d, dict) or not d.get("path"):
            raise ValueError(f"{d} has no path")
        for t in d.get("coordinateTransformations") or []:
            if t.get("type") not in ("scale", "translation") or len(t[t["type"]]) != ndim:
                raise ValueError(f"{t} does not fit {ndim} dimensions")
    return datasets


def multiscales(datasets: list[dict], axes: list[dict], name: str | None = None, **more: object) -> dict:
    block = {"version": "0.4", "datasets": checked_datasets(datasets, len(axes)), "axes": axes}
    if name:
        block["name"] = name
    omero = more.pop("omero", None)
    out: dict = {"multiscales": [block | ({"metadata": more} if more else {})]}
    if omero is not None:
        for channel in omero.get("channels", []):
            window = channel.get("window", {})
            if window and not {"min", "max", "start", "end"} <= set(window):
                raise ValueError("a channel window needs min, max, start and end")
        out["omero"] = omero
    return out


def label_metadata(colors: dict[int, list[int]] | None = None, properties: dict[int, dict] | None = None, source: str = "../../") -> dict:
    image: dict = {"version": "0.4", "source": {"image": source}}
    if colors:
        image["colors"] = [{"label-value": k, "rgba": v} for k, v in sorted(colors.items())]
    if properties:
        image["properties"] = [{"label-value": k} | v for k, v in sorted(properties.items())]
    return {"image-label": image}


#: What the parts of plates and wells are made of: type of each field, and which of them must be there.
FIELDS = {
    "acquisition": ({"id": int, "name": str, "maximumfieldcount": int, "description": str, "starttime": int, "endtime": int}, {"id"}),
    "well": ({"path": str, "rowIndex": int, "columnIndex": int}, {"path", "rowIndex", "columnIndex"}),
    "image": ({"path": str, "acquisition": int}, {"path"}),
}


def checked_part(kind: str, part: object) -> dict:
    """A part whose fields are there and of their types; fields that are not described may hold anything."""
    types, needed = FIELDS[kind]
    if not isinstance(part, dict) or needed - part.keys():
        raise ValueError(f"{kind} {part} needs {', '.join(sorted(needed))}")
    if wrong := [k for k, v in part.items() if k in types and not isinstance(v, types[k])]:
        raise ValueError(f"{kind} {part}: {', '.join(wrong)} of the wrong type")
    return part


def _described(labels: list[str]) -> list[dict]:
    if len(set(labels)) < len(labels) or not all(map(str.isalnum, labels)):
        raise ValueError(f"{labels} must be alphanumeric and all different")
    return [{"name": label} for label in labels]


def plate_metadata(rows: list[str], columns: list[str], wells: list, acquisitions: list[dict] | None = None, fields: int | None = None, name: str | None = None) -> dict:
    """A plate; wells are paths such as B/3, or dictionaries that must agree with the place of their path."""
    plate: dict = {"version": "0.4", "rows": _described(rows), "columns": _described(columns)}
    places = {f"{r}/{c}": {"path": f"{r}/{c}", "rowIndex": i, "columnIndex": j} for i, r in enumerate(rows) for j, c in enumerate(columns)}
    given = [places.get(w, {}) if isinstance(w, str) else w for w in wells]
    plate["wells"] = [checked_part("well", w) for w in given]
    if not wells or any(places.get(w["path"]) != {k: w[k] for k in FIELDS["well"][1]} for w in plate["wells"]):
        raise ValueError(f"wells {wells} are not places of the plate")
    optional = {"acquisitions": [checked_part("acquisition", a) for a in acquisitions] if acquisitions is not None else None, "field_count": fields, "name": name}
    return {"plate": plate | {k: v for k, v in optional.items() if v is not None}}


def well_metadata(images: list) -> dict:
    return {"well": {"version": "0.4", "images": [checked_part("image", {"path": i} if isinstance(i, str) else i) for i in images]}}
