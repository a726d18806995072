"""Diagram texts from a handful of collected nodes and edges."""

from __future__ import annotations

from collections.abc import Callable

from codequarry import fixed_values as fixed

FORMATS = ["mermaid", "plantuml", "dot", "ascii"]


def _by(nodes: list[dict], key: Callable[[dict], str]) -> dict[str, list[dict]]:
    groups: dict[str, list[dict]] = {}
    for node in nodes:
        groups.setdefault(key(node), []).append(node)
    return groups


def _layer(node: dict) -> str:
    return node["extra"]["layer"] or "unknown"


def _methods(node: dict) -> list[str]:
    return (node["extra"]["methods"] or [])[:5]


def mermaid(kind: str, title: str, nodes: list[dict], edges: list[dict]) -> str:
    head = {"sequence": "sequenceDiagram", "class": "classDiagram", "dataflow": "flowchart LR"}.get(kind, "flowchart TD")
    out = [head, f"    %% {title}"]
    if kind == "sequence":
        out += [f"    participant {n['id']} as {n['label']}" for n in nodes]
        out += [f"    {e['source']}->>+{e['target']}: {e['label'] or 'call'}" for e in edges]
        return "\n".join(out)
    if kind == "class":
        for n in nodes:
            out.append(f"    class {n['id']} {{")
            out += ["        <<interface>>"] if n["type"] == "interface" else []
            out += [f"        +{m}()" for m in _methods(n)] + ["    }"]
        links = {"implements": "<|..", "extends": "<|--"}
        out += [f"    {e['target']} {links[e['type']]} {e['source']}" if e["type"] in links else f"    {e['source']} --> {e['target']}" for e in edges]
        return "\n".join(out)
    shapes = {"source": "[({})]", "sink": "[/{}/]", "processor": "[{}]", "entry": "(({}))", "class": "[{}]"}
    if kind == "architecture":
        groups = _by(nodes, _layer)
        for layer in [l for l in fixed.LAYER_ORDER if l in groups]:
            out.append(f"    subgraph {layer.title()} Layer")
            out += [f"        {n['id']}[{n['label']}]" for n in groups[layer]] + ["    end"]
    else:
        out += [f"    {n['id']}{shapes.get(n['type'], '({})').format(n['label'])}" for n in nodes]
    for e in edges:
        arrow = "-->" if kind == "dataflow" or e["type"] == "call" else "-.->"
        out.append(f"    {e['source']} {arrow}{'|' + e['label'] + '|' if e['label'] else ''} {e['target']}")
    return "\n".join(out)


def plantuml(kind: str, title: str, nodes: list[dict], edges: list[dict]) -> str:
    out = ["@startuml", f"title {title}", ""]
    if kind == "sequence":
        out += [f'participant "{n["label"]}" as {n["id"]}' for n in nodes] + [""]
        out += [f"{e['source']} -> {e['target']}: {e['label'] or 'call'}" for e in edges]
    elif kind == "class":
        for n in nodes:
            out.append(f"{'interface' if n['type'] == 'interface' else 'class'} {n['id']} {{")
            out += [f"  +{m}()" for m in _methods(n)] + ["}", ""]
        links = {"implements": "..|>", "extends": "--|>"}
        out += [f"{e['source']} {links.get(e['type'], '-->')} {e['target']}" for e in edges]
    else:
        for n in nodes:
            if n["type"] == "component":
                out.append(f"component [{n['label']}] as {n['id']}")
            elif n["type"] == "module":
                out += [f"package {n['id']} {{", "}"]
            else:
                out.append(f'rectangle {n["id"]} as "{n["label"]}"')
        out.append("")
        out += [f"{e['source']} --> {e['target']}{' : ' + e['label'] if e['label'] else ''}" for e in edges]
    return "\n".join([*out, "", "@enduml"])


def dot(kind: str, title: str, nodes: list[dict], edges: list[dict]) -> str:
    out = [f'digraph "{title}" {{', "    rankdir=TB;", "    node [shape=box, style=rounded];", ""]
    if kind == "architecture":
        for layer, members in _by(nodes, _layer).items():
            out += [f"    subgraph cluster_{layer} {{", f'        label="{layer.title()} Layer";']
            out += [f'        {n["id"]} [label="{n["label"]}"];' for n in members] + ["    }"]
    else:
        out += [f'    {n["id"]} [label="{n["label"]}", shape={"ellipse" if n["type"] == "entry" else "box"}];' for n in nodes]
    out.append("")
    for e in edges:
        style = "dashed" if e["type"] == "import" else "solid"
        label = f'label="{e["label"]}", ' if e["label"] else ""
        out.append(f"    {e['source']} -> {e['target']} [{label}style={style}];")
    return "\n".join([*out, "}"])


def ascii_text(kind: str, title: str, nodes: list[dict], edges: list[dict]) -> str:
    bar, rule = "=" * 60, "-" * 40
    out = [bar, f"  {title}", bar, "", "NODES:", rule]
    for node_type, members in _by(nodes, lambda n: n["type"]).items():
        out.append(f"\n[{node_type.upper()}]")
        out += [f"  • {n['label']}" + (f" ({n['file']})" if n["file"] else "") for n in members]
    out += ["", "RELATIONSHIPS:", rule]
    out += [f"  {e['source']} --> {e['target']}" + (f" ({e['label']})" if e["label"] else "") for e in edges]
    return "\n".join([*out, "", bar])


RENDERERS = {"mermaid": mermaid, "plantuml": plantuml, "dot": dot, "ascii": ascii_text}


def render(output_format: str, kind: str, title: str, nodes: list[dict], edges: list[dict]) -> str:
    return RENDERERS[output_format](kind, title, nodes, edges)
