"""Near-duplicate lines by a segment-partition join and banded bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import col
from plumbline.llm.common import key_filter, maybe_in, saved, words
from plumbline.llm.graph import connected_components

#: Lines of a null id come after all others; a place is id * LINES + line number.
NO_ID, LINES = str(2**63), 2**32
#: A list of several classes is compared with about this many of its lines at first, and with as many times more in each further round.
PIVOTS = 8
#: Numbers of 64 bits that tell of the words of a line, see ``word_parity``.
PARITIES = 4
#: (least words of a line, edits of whole words allowed): about a tenth of the words, less for the longest lines.
WORD_BANDS = ((10, 1), (20, 2), (40, 4), (80, 6), (160, 8), (320, 12), (640, 16), (1280, 24), (2560, 32), (5120, 48), (10240, 64), (20480, 96))


def segment(length: Column, number: Column, segments: int) -> tuple[Column, Column]:
    """(first position from 0, length) of one of the almost equal segments of a line of ``length`` characters."""
    start = (length * number / segments).cast("int")
    return start, (length * (number + 1) / segments).cast("int") - start


def index_shapes(max_edits: int) -> Column:
    """The segments that a line is posted under, as array<struct<shorter, number, shift>>; see ``key_of``."""
    return _shapes([(0, number, 0) for number in range(max_edits + 1)])


def probe_shapes(max_edits: int) -> Column:
    """Where to look for the segments of lines of the same length or up to ``max_edits`` shorter, within ``max_edits``; among them all of ``index_shapes``.

    A line that is shorter by d keeps some segment unchanged, and, looking for it from both ends of the line, it
    is enough to seek segment k shifted by s with |s| <= k, |s - d| <= max_edits - k and
    |s| + |s - d| <= max_edits: edits before it and edits behind it.
    """
    return _shapes(_probes(max_edits))


def _probes(max_edits: int) -> list[tuple[int, int, int]]:
    return [
        (shorter, number, shift)
        for shorter in range(max_edits + 1) for number in range(max_edits + 1) for shift in range(-number, number + 1)
        if abs(shift - shorter) <= max_edits - number and abs(shift) + abs(shift - shorter) <= max_edits
    ]


def _shapes(shapes: list[tuple[int, int, int]]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("shorter", "number", "shift"))]) for s in shapes])


def _place(length: Column, shape: Column, max_edits: int) -> tuple[Column, Column, Column]:
    """(length of the lines sought, first position from 0, size) of the characters that a shape of a line of ``length`` names."""
    of = length - shape["shorter"]
    start, size = segment(of, shape["number"], max_edits + 1)
    return of, start + shape["shift"], size


def key_of(line: Column, length: Column, shape: Column, max_edits: int) -> Column:
    """Hash of a length, a segment's number and the characters at that segment's place; null if they would lie outside."""
    of, at, size = _place(length, shape, max_edits)
    return F.when((at >= 0) & (at + size <= length), F.xxhash64(of, shape["number"], F.substring(line, at + 1, size)))


def run_shapes(edits: int) -> list[tuple[int, int]]:
    """(run, shift) of the runs of words that a line of a band has or seeks; it is posted under those without a shift.

    Of two lines within ``edits`` edits of words, one has a run i unchanged with exactly i edits before it: counting
    the edits that fall into each run, take the first run up to whose end there are fewer edits than runs. So at most
    ``edits - i`` are behind it. Lines seek the runs of lines with no more words than they have, so
    run i stands at a shift from -min(i, edits - i) to i words.
    """
    return [(i, shift) for i in range(edits + 1) for shift in range(-min(i, edits - i), i + 1)]


#: A shape is one number: posted + 2 * (shift + SHIFTS / 2 + SHIFTS * (number of segment or run + RUNS * (band + BANDS * shorter))).
SHIFTS, RUNS, BANDS = 1024, 1024, 64


def _shape(band: int, number: int, shift: int, shorter: int, posted: bool) -> int:
    return int(posted) + 2 * (shift + SHIFTS // 2 + SHIFTS * (number + RUNS * (band + BANDS * shorter)))


def line_shapes(n_words: Column, max_edits: int, bands: tuple[tuple[int, int], ...], spelled_below: int | None) -> Column:
    """array<long>: the shapes of a line of so many words, see ``_shape``; the band numbered len(bands) stands for segments of characters.

    A line has the shapes of its own band, and those of the band below, without being posted, if lines of that may be near it.
    """
    spelled = [_shape(len(bands), number, shift, shorter, shorter == shift == 0) for shorter, number, shift in _probes(max_edits)]
    above = [least for least, _ in bands[1:]] + [None]
    borders = {0, *([] if spelled_below is None else [spelled_below]), *[least for least, _ in bands]}
    borders |= {up + edits for (_, edits), up in zip(bands, above) if up is not None}
    shapes = F.lit(None)
    for n in sorted(borders):
        held = spelled if spelled_below is None or n < spelled_below else []
        for i, ((least, edits), up) in enumerate(zip(bands, above)):
            if least <= n and (up is None or n < up + edits):
                own = up is None or n < up
                held = held + [_shape(i, run, shift, 0, own and shift == 0) for run, shift in run_shapes(edits)]
        # one text that is split once, when the query is planned: thousands of literals would be nodes of the plan
        every = F.split(F.lit(",".join(map(str, held))), ",").cast("array<long>") if held else F.lit(None).cast("array<long>")
        shapes = F.when(n_words >= n, every).otherwise(shapes)
    return shapes


def _pieces(line: Column) -> Column:
    """The words of a line that is not null, see ``words``: nearly all lines have spaces only, and those need no regular expression."""
    spaced = F.when(line.rlike(r"[\x09-\x0D]"), F.regexp_replace(line, r"[\x09-\x0D]", " ")).otherwise(line)
    return F.array_remove(F.split(spaced, " ", -1), "")


def _once(value: Column) -> Column:
    """A value behind a generator, so that what is asked of it later does not work it out again."""
    return F.explode(F.array(value))


def keys_of_lines(lines: DataFrame, probe: bool, max_edits: int, bands: tuple[tuple[int, int], ...], spelled_below: int | None) -> DataFrame:
    """(h1, key, posted): where lines (``line``, ``h1``) seek others, with a mark at what they are posted under; if not ``probe`` the latter only.

    Those of less than ``spelled_below`` words (None: all) by segments of characters, see ``key_of``, and all by hashes of runs of
    words. A line is read and split once for all its keys. A row per shape comes first, so that a key is one small compiled expression.
    """
    hashes = F.transform(_pieces(F.col("line")), lambda word: F.xxhash64(word))
    hashed = lines.select("h1", "line", F.length("line").alias("length"), _once(hashes).alias("hashes"))
    shaped = hashed.withColumn("n_words", F.size("hashes")).select("*", F.explode(line_shapes(F.col("n_words"), max_edits, bands, spelled_below)).alias("shape"))
    part = lambda over, of: F.shiftright("shape", over.bit_length() - 1).bitwiseAND(F.lit(of - 1)).cast("int")
    posted, band = F.col("shape").bitwiseAND(F.lit(1)) == 1, part(2 * SHIFTS * RUNS, BANDS)
    number, shift = part(2 * SHIFTS, RUNS), part(2, SHIFTS) - SHIFTS // 2
    spelling = F.struct(part(2 * SHIFTS * RUNS * BANDS, BANDS).alias("shorter"), number.alias("number"), shift.alias("shift"))
    of, at, size = _place(F.col("length"), spelling, max_edits)
    fits, key = (at >= 0) & (at + size <= F.col("length")), F.xxhash64(of, number, F.substring(F.col("line"), at + 1, size))
    if bands:
        per_band = lambda values: F.get(F.array(*map(F.lit, values)), band)
        run_size = per_band([least // (edits + 1) for least, edits in bands])
        at = number * run_size + shift
        run_key = F.xxhash64(per_band([least for least, _ in bands]), number, F.slice("hashes", at + 1, run_size))
        in_words = band < len(bands)
        fits, key = F.when(in_words, at + run_size <= F.col("n_words")).otherwise(fits), F.when(in_words, run_key).otherwise(key)
    wanted = fits if probe else fits & posted
    return shaped.filter(wanted).select("h1", key.alias("key"), posted.alias("posted"))


def _letters(codes: Column) -> Column:
    """A text with one character for each of the numbers, which are below 2 ** 20."""
    return F.decode(F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c + 0x10000), 8, "0")), "")), "UTF-32")


def word_letters(hashes: Column) -> Column:
    """The words of a line, given by hashes, each as one character: equal words are equal, different ones nearly always differ."""
    return _letters(F.transform(hashes, lambda word: F.pmod(word, F.lit(1 << 20))))


def word_parity(hashes: Column) -> list[Column]:
    """PARITIES times 64 bits: of each, whether an odd number of a line's words, given by hashes, fall to it. An edit of a word turns at most two.

    With 64 bits alone, lines that differ in a few more words than they may, and all lines with many edits, would pass for near.
    """
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    turned = lambda i: lambda bits, x: F.when(F.pmod(F.shiftright(x, 6), F.lit(PARITIES)) == i, bits.bitwiseXOR(bit(x))).otherwise(bits)
    return [F.aggregate(hashes, F.lit(0).cast("long"), turned(i)) for i in range(PARITIES)]


def _as_letters(a: Column, b: Column) -> Column:
    """struct<a, b>: the words of two lines, each as one character by its place among the words of both."""

    def placed(known: Column, line: Column) -> Column:
        return _letters(F.transform(words(line), lambda word: F.call_function("array_position", known, word)))

    every = F.array_distinct(F.concat(words(a), words(b)))
    return _with(every, lambda known: F.struct(placed(known, a).alias("a"), placed(known, b).alias("b")))


def edits_allowed(n_words: Column, bands: tuple[tuple[int, int], ...]) -> Column:
    """How many edits of words a line of so many words may be from a longer one; -1 if it has too few."""
    allowed = F.lit(-1)
    for least, edits in bands:
        allowed = F.when(n_words >= least, edits).otherwise(allowed)
    return allowed


def words_within(exact: bool) -> Column:
    """Whether the lines of the two sides (columns of ``_a`` and ``_b``) are within the edits of words that the shorter one allows.

    If not ``exact``, words are told apart by ``word_letters`` only, and a pair too many may pass, but none is lost. It is
    kept short, as the JVM never compiles a method of over 8,000 bytes.
    """
    n_a, n_b = F.col("n_words_a"), F.col("n_words_b")
    edits = F.when(n_a <= n_b, F.col("edits_a")).otherwise(F.col("edits_b"))
    turned = sum((F.bit_count(F.col(f"words{i}_a").bitwiseXOR(F.col(f"words{i}_b"))) for i in range(1, PARITIES)), F.bit_count(F.col("words0_a").bitwiseXOR(F.col("words0_b"))))
    within = lambda a, b: F.call_function("levenshtein", a, b, edits) >= 0
    near = (F.abs(n_a - n_b) <= edits) & (turned <= 2 * edits) & within(F.col("letters_a"), F.col("letters_b"))
    if not exact:
        return near
    kinds = lambda items: F.size(F.array_distinct(items))
    told_apart = kinds(F.concat(words(F.col("line_a")), words(F.col("line_b")))) == kinds(F.split(F.concat("letters_a", "letters_b"), ""))
    return near & (told_apart | _with(_as_letters(F.col("line_a"), F.col("line_b")), lambda p: within(p["a"], p["b"])))


def letters_within(max_edits: int) -> Column:
    """Whether the lines of the two sides are within the edits of characters; false, never null, where a line has no ``pair_parity``.

    The null of a comparison with it would not keep the other half of the condition, the distance of two long lines, from being worked out.
    """
    spelled = F.col("parity_a").isNotNull() & F.col("parity_b").isNotNull()
    few = F.bit_count(F.col("parity_a").bitwiseXOR(F.col("parity_b"))) <= 4 * max_edits
    return spelled & few & (F.levenshtein(F.col("line_a"), F.col("line_b"), max_edits) >= 0)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by bisection: a step doubles or halves what is compared."""
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    longer = lambda p, known, step: (known + step <= p["limit"]) & (
        F.substring(p["a"], known + 1, step) == F.substring(p["b"], known + 1, step)
    )
    texts = F.struct(a.alias("a"), b.alias("b"), F.least(F.length(a), F.length(b)).alias("limit"))
    return _with(texts, lambda p: F.aggregate(
        steps, F.lit(0), lambda known, step: F.when(longer(p, known, step), known + step).otherwise(known)
    ))


def edit_distance_within(a: Column, b: Column, max_edits: int) -> Column:
    """Levenshtein distance of two texts if it is at most ``max_edits``, else ``max_edits + 1``; null for a null.

    Common ends are taken off first. Of what is left, each character of ``b`` updates a band of
    ``2 * max_edits + 1`` cells around the diagonal at once: the band's vertical steps up and down are the
    bits of two numbers, and additions and shifts carry the recurrence through all cells (bit-parallel).
    """

    def front(p: Column) -> Column:
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), _common_prefix(p["a"], p["b"]).alias("same"))

    def without_front(p: Column) -> Column:
        rest = lambda x: F.substring(x, p["same"] + 1, F.lit(2**31 - 1))
        return F.struct(rest(p["a"]).alias("a"), rest(p["b"]).alias("b"))

    def back(p: Column) -> Column:
        same = _common_prefix(F.reverse(p["a"]), F.reverse(p["b"]))
        sizes = (F.length(p["a"]).alias("m"), F.length(p["b"]).alias("n"))
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), *sizes, same.alias("same"))

    def spelled(p: Column) -> Column:
        m, n = p["m"] - p["same"], p["n"] - p["same"]
        letters = lambda x, size: F.split(F.substring(x, F.lit(1), size), "")
        return F.struct(letters(p["a"], m).alias("a"), letters(p["b"], n).alias("b"), m.alias("m"), n.alias("n"))

    steps = F.array(F.struct(a.alias("a"), b.alias("b")))
    for part in (front, without_front, back, spelled):
        steps = F.transform(steps, part)
    distance = F.transform(steps, lambda p: _banded(p["a"], p["b"], p["m"], p["n"], max_edits))[0]
    return F.when(a.isNotNull() & b.isNotNull(), distance)


def pair_parity(line: Column) -> Column:
    """64 bits: of each, whether an odd number of the line's neighbouring characters hash to it.

    An edit takes away at most two pairs of neighbours and brings two, so it turns at most four bits.
    """
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    pairs = lambda letters: F.transform(letters, lambda c, i: F.xxhash64(F.get(letters, i - 1), c))
    hashed = _with(F.split(line, ""), pairs)
    return F.aggregate(hashed, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(bit(x)))


def _banded(a: Column, b: Column, m: Column, n: Column, k: int) -> Column:
    width = 2 * k + 1
    full = (1 << width) - 1
    flip = lambda x: x.bitwiseXOR(F.lit(full))

    def step(state: Column, j: Column) -> Column:
        """Column j (from 1): bit i of the band is row j - k + i of ``a``."""
        up, down = state["up"], state["down"]
        letter = F.get(b, j - 1)
        same = F.lit(0)
        for i in range(width):
            row = j - k + i
            same = same.bitwiseOR(F.when((row >= 1) & (row <= m) & (F.get(a, F.greatest(row - 1, F.lit(0))) == letter), 1 << i).otherwise(0))
        begun = F.struct(same.alias("same"), up.alias("up"), down.alias("down"))

        def carried(s: Column) -> Column:
            spread = (s["same"].bitwiseAND(s["up"]) + s["up"]).bitwiseXOR(s["up"])
            return spread.bitwiseOR(s["same"]).bitwiseOR(s["down"]).bitwiseAND(F.lit(full))

        def ended(s: Column) -> Column:
            right = s["down"].bitwiseOR(flip(s["diagonal"].bitwiseOR(s["up"])))
            left = s["diagonal"].bitwiseAND(s["up"])
            below = F.shiftright(s["diagonal"], 1)
            return F.struct(
                left.bitwiseOR(flip(below.bitwiseOR(right))).alias("up"),
                below.bitwiseAND(right).alias("down"),
                (state["distance"] + F.when(s["diagonal"].bitwiseAND(F.lit(1 << (width - 1))) == 0, 1).otherwise(0)).alias("distance"),
            )

        with_diagonal = F.transform(F.array(begun), lambda s: F.struct(carried(s).alias("diagonal"), s["up"].alias("up"), s["down"].alias("down")))
        # no cell of the band is more than 2k below its lowest row, so beyond 3k no path can come back to k
        return F.when(state["distance"] > 3 * k, state).otherwise(F.transform(with_diagonal, ended)[0])

    # column 0: row i has distance i, so steps go up in the rows from 1 to k, bits k to 2k - 1 once the band has moved
    start = F.struct(F.lit(full & ~((1 << k) - 1)).alias("up"), F.lit(0).alias("down"), F.lit(k).alias("distance"))
    last = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), start, step)

    def read(s: Column) -> Column:
        """From the band's lowest row n + k go back up to row m: bits m - n + k to 2k - 1."""
        distance = s["distance"]
        for i in range(width - 1):
            counted = F.when(m - n + k <= i, 1).otherwise(0)
            bit = lambda x, i=i: F.shiftright(x, i).bitwiseAND(F.lit(1))
            distance = distance - counted * (bit(s["up"]) - bit(s["down"]))
        return F.when(s["distance"] > 3 * k, k + 1).otherwise(distance)

    return F.when(F.abs(m - n) > k, k + 1).otherwise(F.least(_with(last, read), F.lit(k + 1)))


def deduplicate_lines(
    docs: DataFrame,
    max_edits: int = 2,
    least_chars: int = 24,
    id_column: str = "doc_id",
    text_column: str = "text",
    word_bands: tuple[tuple[int, int], ...] = WORD_BANDS,
    short_copies: bool = False,
) -> DataFrame:
    """Drop from every document the lines that, but for a few edits, stand at an earlier place of the corpus.

    Lines are what ``\\n`` separates. Those of at least ``least_chars`` characters count; of shorter ones, with ``short_copies``,
    those with a letter count as exact copies only, and all others always stay. Two longer
    lines are linked if their Levenshtein distance is at most ``max_edits`` characters, or at most as many whole words as
    ``word_bands`` allows for the number of words of the shorter one; linked lines form classes, and of a class
    the first place stays, in order of doc_id and line number.

    Each line is cut into ``max_edits + 1`` segments, one of which every linked line has too, shifted by a few
    characters at most. Lines are posted under their segments (with length and number) and probe those of lines as long
    or a little shorter; likewise under runs of words, see ``run_shapes``. Lines whose edits of words cover any ``max_edits``
    edits of characters do without segments of characters. A posting list's members are compared with its first line. Lists whose members then fall
    into several classes take pivots, about ``PIVOTS`` of their members by a hash, with which all members of other classes are compared; what is close is
    united, and lists that still have several classes take ``PIVOTS`` times as many, until each has one class or all its members have been pivots.
    So a line is mostly united by one of the first pivots near it and is not compared within its class again: per list, line and round about three close pairs
    come out at most (with x pivots near it so far, ``PIVOTS`` * x * exp(-x) are expected), not one for each close line. Comparisons in the join's
    condition go first by the bits of ``pair_parity`` or ``word_parity``, then by distance. Candidates are verified by ``edit_distance_within``
    or the distance in words.
    Texts are moved only where they are needed: filters of fixed size find the candidate lines and the documents that
    lose lines; all other rows pass by the joins.

    Result: the columns of ``docs`` in their order with the shortened text, and n_lines, n_dropped (long). Rows of the
    same id and text are one document and fare alike; documents that share an id but not the text share their places.
    Null ids come last. A null text stays null, with no lines; a text whose lines all go becomes empty; empty
    tables give no rows. Columns of other names pass through untouched; input columns n_lines and n_dropped are replaced.
    """
    others = [c for c in docs.columns if c != text_column]
    whole = docs.select(
        F.struct(*[col(c) for c in others]).alias("row"), col(id_column).cast("long").alias("id"), col(text_column).alias("text")
    )
    texts = whole.select("id", "text", F.xxhash64("text").alias("text_key"))
    split = texts.select("id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("number", "line"))
    sized = split.withColumn("length", F.length("line"))
    long = sized.filter(F.col("length") >= least_chars)
    counted = sized.filter((F.col("length") >= least_chars) | F.col("line").rlike(r"\p{L}")) if short_copies else long
    place = F.coalesce("id", F.lit(NO_ID).cast("decimal(20,0)")) * F.lit(LINES).cast("decimal(10,0)") + F.col("number")
    lines = long.select("line", F.xxhash64("line").alias("h1"))
    # an edit of a character is at most two of words, so from here on the words find all pairs; it moves a line by one word at most
    covered = min((least for least, edits in word_bands if edits >= 2 * max_edits), default=None)
    spelled_below = None if covered is None else covered + max_edits
    # a list's rows are dealt out and sorted once, and its first line is found where they lie
    keys = keys_of_lines(lines, True, max_edits, word_bands, spelled_below)
    head = F.min(F.when(F.col("posted"), F.col("h1"))).over(Window.partitionBy("key"))
    found = keys.withColumn("head", head).filter("h1 <> head").select("key", "h1", "head").distinct()
    met = saved(found.hint("rebalance"), "line-lists")  # in few files, as they are read often
    members = saved(met.select("key", "h1").unionByName(met.select("key", F.col("head").alias("h1"))).distinct(), "line-members")
    wanted = members.select(F.col("h1").alias("key")).distinct()
    named = lines.filter(maybe_in(key_filter(wanted), F.col("h1"))).join(wanted, F.col("h1") == F.col("key"), "left_semi").distinct()
    spelled = F.lit(True) if spelled_below is None else F.col("n_words") < spelled_below
    hashes = _once(F.transform(_pieces(F.col("line")), lambda word: F.xxhash64(word)))
    own = ("line", "n_words", "edits", "letters", *[f"words{i}" for i in range(PARITIES)], "parity")
    candidate = saved(
        named.select("h1", "line", hashes.alias("hashes")).withColumn("n_words", F.size("hashes")).withColumn("edits", edits_allowed(F.col("n_words"), word_bands))
        .withColumn("letters", word_letters(F.col("hashes")))
        .withColumns({f"words{i}": bits for i, bits in enumerate(word_parity(F.col("hashes")))})
        .withColumn("parity", F.when(spelled, pair_parity(F.col("line")))).select("h1", *own),
        "line-texts",
    )

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda n: candidate.select(F.col("h1").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in own])
        close = edit_distance_within(F.col("line_a"), F.col("line_b"), max_edits) <= max_edits
        lengths = F.abs(F.length("line_a") - F.length("line_b")) <= max_edits
        few = F.lit(True) if covered is None else F.least("n_words_a", "n_words_b") < covered
        return saved(
            pairs.distinct().join(side("b"), "b").join(side("a"), "a")
            .filter(words_within(exact=True) | (lengths & few & close)).select("a", "b"),
            "line-links",
        )

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    classes = connected_components(verified(met.select(*ordered("head", "h1"))))

    def opened(done: int) -> DataFrame:
        """The lists of more than ``done`` members whose members fall into several classes by now."""
        grouped = members.join(classes, F.col("h1") == F.col("node"), "left").select("key", "h1", F.coalesce("component", "h1").alias("class"))
        several = grouped.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n"))
        some = several.filter((F.col("low") < F.col("high")) & (F.col("n") > F.greatest(F.lit(2), F.lit(done)))).select("key", "n")
        return saved(grouped.join(some, "key"), "line-open")

    def close_pairs(some: DataFrame, others: DataFrame) -> DataFrame:
        side = lambda rows, n: rows.join(candidate, "h1").select("key", F.col("h1").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("class", *own)])
        one, other = side(some, "a"), side(others, "b")
        return one.join(
            other,
            (one["key"] == other["key"]) & (F.col("class_a") != F.col("class_b"))
            & (words_within(exact=False) | letters_within(max_edits)),
        ).select(*ordered("a", "b"))

    # a line's draw from 0 to 1 is the same in all its lists; a list of n members takes those drawn below pivots / n
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("pivot"), "h1"), 11) / F.lit(float(2**53))
    done, pivots = 0, PIVOTS
    while not (open_ := opened(done)).isEmpty():
        chosen = open_.filter((draw * F.col("n") >= done) & (draw * F.col("n") < pivots))
        near = verified(close_pairs(open_, chosen))
        classes = connected_components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(near))
        done, pivots = pivots, pivots * PIVOTS

    located = saved(counted.select("id", "text_key", "number", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("again"), "line").alias("h2"), place.alias("place")), "line-places")
    placed = located.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n")).join(
        classes, F.col("h1") == F.col("node"), "left"
    )
    shared = saved(placed.filter("n > 1 or component is not null"), "line-classes")
    alone = shared.filter("component is null").select("h1", "h2", F.col("place").alias("first"))
    linked = shared.filter("component is not null")
    of_class = linked.groupBy("component").agg(F.min("place").alias("first"))
    repeated = alone.unionByName(linked.join(of_class, "component").select("h1", "h2", "first"))
    dropped = saved(
        located.join(repeated, ["h1", "h2"]).filter("place <> first").groupBy("id", "text_key").agg(F.collect_set("number").alias("numbers")),
        "line-dropped",
    )

    rows = whole.withColumn("text_key", F.xxhash64("text"))
    doc_key = F.xxhash64(F.coalesce("id", F.lit(0)), "text_key")
    hit = maybe_in(key_filter(dropped.select(doc_key.alias("key"))), doc_key)
    loss = dropped.select(F.col("id").alias("lost_id"), F.col("text_key").alias("lost_key"), "numbers")
    flagged = rows.withColumn("hit", hit)
    shortened = flagged.filter("hit").join(
        loss, flagged["id"].eqNullSafe(loss["lost_id"]) & (flagged["text_key"] == loss["lost_key"]), "left"
    )
    parts = F.split("text", "\n", -1)
    rest = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains("numbers", i)), "\n")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts))
    untouched = F.col("numbers").isNull()
    kept = shortened.select(
        "row", n_lines.alias("n_lines"), F.when(untouched, F.col("text")).otherwise(rest).alias("text"),
        F.when(untouched, 0).otherwise(F.size("numbers")).alias("n_dropped"),
    )
    out = flagged.filter("not hit").select("row", n_lines.alias("n_lines"), "text", F.lit(0).alias("n_dropped")).unionByName(kept)
    return out.select(
        *[F.col("text").alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"),
    )
