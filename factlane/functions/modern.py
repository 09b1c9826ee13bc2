"""Facts of newer class files: modules, records, sealed and nest relations, dynamic constants and concatenation sites."""

from __future__ import annotations

from . import classfile as C

#: The bootstrap methods of string concatenation.
CONCAT = (b"java/lang/invoke/StringConcatFactory", (b"makeConcat", b"makeConcatWithConstants"))


def facts(f: C.ClassFile) -> list[dict]:
    """(fact, name, value) rows in the order of the attributes; what cannot be read is a row named ``damaged``."""
    out: list[dict] = []
    put = lambda fact, name, value=None: out.append({"fact": fact, "name": name, "value": value})
    for a in f.attributes:
        try:
            c = f.body(a)
            if a.name == b"Record":
                for _ in range(c.u2()):
                    put("record_component", f.utf8(c.u2()), f.utf8(c.u2()))
                    for _ in range(c.u2()):
                        c.u2()
                        c.take(c.u4())
            elif a.name in (b"PermittedSubclasses", b"NestMembers", b"ModulePackages"):
                for _ in range(c.u2()):
                    put(a.name.decode(), f.class_name(c.u2()))
            elif a.name in (b"NestHost", b"ModuleMainClass"):
                put(a.name.decode(), f.class_name(c.u2()))
            elif a.name == b"Module":
                put("module", f.class_name(c.u2()))
                c.take(2)
                c.u2()
                for _ in range(c.u2()):
                    put("requires", f.class_name(c.u2()))
                    c.take(4)
        except C.Damaged as e:
            put("damaged", a.name, e.code.encode())
    try:
        methods = C.bootstrap_methods(f)
        for index, item in f.pool.items():
            if item[0] == C.INVOKE_DYNAMIC and item[1] < len(methods):
                _, owner, name, _ = f.reference(f.constant(methods[item[1]][0], C.METHOD_HANDLE)[2])
                if owner == CONCAT[0] and name in CONCAT[1]:
                    put("concat_site", str(index).encode(), f.pair(item[2])[1])
    except C.Damaged as e:
        put("damaged", b"BootstrapMethods", e.code.encode())
    return out


def dynamic_graph(f: C.ClassFile, most_nodes: int = 4096, most_depth: int = 64) -> dict:
    """Dependencies between dynamic constants: {edges, cycles, reach, state}; bootstraps are never run.

    reach is, for each constant, the number of others that it depends on; state tells whether a bound stopped the walk.
    """
    edges, cycles, state = [], [], "complete"
    methods = C.bootstrap_methods(f)
    nodes = [i for i, item in f.pool.items() if item[0] in (C.DYNAMIC, C.INVOKE_DYNAMIC)]
    below: dict[int, list[int]] = {}
    for i in nodes:
        given = methods[f.pool[i][1]][1] if f.pool[i][1] < len(methods) else []
        below[i] = [g for g in given if f.pool.get(g, (0,))[0] == C.DYNAMIC]
        edges += [(i, g) for g in below[i]]
    reach = {}
    for i in nodes[:most_nodes]:
        seen: set[int] = set()
        work = [(i, 0)]
        while work:
            at, depth = work.pop()
            for g in below.get(at, ()):
                if g == i:
                    cycles.append(i)
                elif g not in seen:
                    if depth + 1 > most_depth:
                        state = "depth_bound"
                        continue
                    seen.add(g)
                    work.append((g, depth + 1))
        reach[i] = len(seen)
    return {"edges": edges, "cycles": sorted(set(cycles)), "reach": reach, "state": "node_bound" if len(nodes) > most_nodes else state}
