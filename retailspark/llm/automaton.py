"""Suffix automaton over sequences of integers, built online for several sequences."""


class SuffixAutomaton:
    """Accepts the substrings of all sequences added. State 0 is the empty one."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, codes):
        last = 0
        for code in codes:
            last = self.extend(last, code)

    def extend(self, last, code):
        """Appends ``code`` to the sequence whose state is ``last``; returns the state of the longer one."""
        follow, link, length = self.next, self.link, self.length
        target = follow[last].get(code)
        if target is not None:
            if length[target] == length[last] + 1:
                return target
            return self._split(last, code, target)
        state = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and code not in follow[at]:
            follow[at][code] = state
            at = link[at]
        if at >= 0:
            target = follow[at][code]
            link[state] = target if length[target] == length[at] + 1 else self._split(at, code, target)
        return state

    def _split(self, at, code, target):
        follow, link, length = self.next, self.link, self.length
        clone = len(follow)
        follow.append(dict(follow[target]))
        link.append(link[target])
        length.append(length[at] + 1)
        link[target] = clone
        while at >= 0 and follow[at].get(code) == target:
            follow[at][code] = clone
            at = link[at]
        return clone

    def stream(self, codes):
        """Matching statistics: for each place, the length of the longest suffix that the automaton holds, and its state."""
        follow, link, length = self.next, self.link, self.length
        state = matched = 0
        for place, code in enumerate(codes):
            while state and code not in follow[state]:
                state = link[state]
                matched = length[state]
            target = follow[state].get(code)
            if target is None:
                matched = 0
            else:
                state, matched = target, matched + 1
            yield place, matched, state

    def shrink(self, state, width):
        """The state of the last ``width`` codes of a match that ended in ``state``."""
        link, length = self.link, self.length
        while length[link[state]] >= width:
            state = link[state]
        return state

    def windows(self, codes, width):
        """Last place and state of each window of ``width`` codes that the automaton holds."""
        for place, matched, state in self.stream(codes):
            if matched >= width:
                yield place, self.shrink(state, width)
