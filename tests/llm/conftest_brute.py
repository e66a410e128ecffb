"""Plain versions that the operators are held against."""


def linked_components(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a in parent and b in parent:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in parent}
