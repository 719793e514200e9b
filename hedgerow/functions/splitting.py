"""Cutting one text into overlapping chunks along its natural boundaries.

Works on offsets: a chunk is always a stretch of the original text, so no pieces are copied or
joined.  At each level the text is cut in front of every occurrence of the first separator it
holds; pieces that fit are packed greedily, a piece that is too long is cut at the next level.
"""

from bisect import bisect_left

from hedgerow.rules import documents as D


def chunk_spans(text, size, overlap, separators=D.CHUNK_SEPARATORS):
    """Offsets (start, end) of the chunks, white space at their ends left out."""
    return list(_spans(text, 0, len(text), 0, size, overlap, separators))


def _spans(text, start, end, level, size, overlap, separators):
    while separators[level] and text.find(separators[level], start, end) < 0:
        level += 1
    cuts = _cuts(text, start, end, separators[level])
    run = [start]
    for left, right in zip(cuts, cuts[1:]):
        if right - left < size:
            run.append(right)
            continue
        yield from _packed(text, run, size, overlap)
        if level + 1 < len(separators):
            yield from _spans(text, left, right, level + 1, size, overlap, separators)
        else:
            yield from _trimmed(text, left, right)
        run = [right]
    yield from _packed(text, run, size, overlap)


def _cuts(text, start, end, separator):
    """Piece boundaries: every separator starts a piece; without one, every character does."""
    if not separator:
        return range(start, end + 1)
    cuts = [start]
    at = text.find(separator, start, end)
    while at >= 0:
        if at > cuts[-1]:
            cuts.append(at)
        at = text.find(separator, at + len(separator), end)
    cuts.append(end)
    return cuts


def _packed(text, marks, size, overlap):
    """Pack the pieces between ``marks`` greedily; at most ``overlap`` characters are repeated."""
    first = 0  # mark the open chunk starts at
    for i in range(len(marks) - 1):
        left, right = marks[i], marks[i + 1]
        if right - marks[first] <= size:
            continue
        if left > marks[first]:
            yield from _trimmed(text, marks[first], left)
        # give up pieces from the front until the tail is short and the next piece fits
        lowest = max(left - overlap, right - size)
        first = min(bisect_left(marks, lowest, first, i), i)
    if len(marks) > 1:
        yield from _trimmed(text, marks[first], marks[-1])


def _trimmed(text, start, end):
    part = text[start:end]
    lead = len(part) - len(part.lstrip())
    kept = len(part.strip())
    if kept:
        yield start + lead, start + lead + kept


def page_chunks(pages, size, overlap):
    """Chunks of the joined non-blank pages: (index, text, page numbers).

    ``pages`` is a list of (page number, text) in order.  Two line breaks join the pages and belong
    to the following one.  A chunk is looked for from just behind the start of the one before.
    """
    starts, numbers, parts, length = [], [], [], 0
    for number, text in pages:
        if text and text.strip():
            starts.append(length)
            numbers.append(number)
            joined = ("\n\n" + text) if parts else text
            parts.append(joined)
            length += len(joined)
    full = "".join(parts)
    position = 0
    for index, (a, b) in enumerate(chunk_spans(full, size, overlap) if full else ()):
        chunk = full[a:b]
        at = full.find(chunk, position)
        at = position if at < 0 else at
        end = min(at + len(chunk), length)
        lo = bisect_left(starts, at + 1) - 1
        hi = bisect_left(starts, end)
        yield index, chunk, sorted(set(numbers[max(lo, 0):hi])) if at < length else []
        position = max(position, at + 1)
