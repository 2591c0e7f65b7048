"""A plain model of template mining, to test the Spark form against."""


def mine(lines):
    """``lines``: ordered (seq, message). Returns {seq: (pattern, variables, opened_seq)}."""
    opened = {}
    for seq, message in lines:
        words = message.split()
        group = opened.setdefault(len(words), [])
        for template in group:
            agreeing = sum(t in ("<*>", w) for t, w in zip(template["tokens"], words))
            if 2 * agreeing >= len(words):
                template["tokens"] = [t if t == w else "<*>" for t, w in zip(template["tokens"], words)]
                template["members"].append((seq, words))
                break
        else:
            group.append({"tokens": words, "members": [(seq, words)], "opened": seq})
    result = {}
    for group in opened.values():
        for template in group:
            for seq, words in template["members"]:
                variables = [w for t, w in zip(template["tokens"], words) if t == "<*>"]
                result[seq] = (" ".join(template["tokens"]), variables, template["opened"])
    return result
