"""Column functions on nucleotide text. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements of the IUPAC codes, and the standard genetic code with codons in TCAG order.
IUPAC = "ACGTURYSWKMBDHVN"
IUPAC_COMPLEMENT = "TGCAAYRSWMKVHDBN"
CODON_BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def reverse_complement(sequence: Column) -> Column:
    """Letters outside the IUPAC codes become N."""
    known = F.regexp_replace(F.upper(sequence), f"[^{IUPAC}]", "N")
    return F.reverse(F.translate(known, IUPAC, IUPAC_COMPLEMENT))


def degapped(sequence: Column) -> Column:
    """Upper case without gaps, U as T."""
    return F.translate(F.upper(sequence), "U-", "T")


def translated_alignment(sequence: Column, frame: int = 0) -> Column:
    """Amino acids of an aligned text by columns of three: a gap for three gaps, X for a codon that is mixed or incomplete."""
    bases = F.substring(F.upper(sequence), frame + 1, 1 << 30)
    starts = F.sequence(F.lit(1), F.greatest(F.length(bases), F.lit(1)), F.lit(3))
    place = lambda codon, k: F.position(F.substring(codon, k, 1), F.lit(CODON_BASES))

    def amino(i: Column) -> Column:
        codon = F.substring(bases, i, F.lit(3))
        a, b, c = (place(codon, k) for k in (1, 2, 3))
        whole = codon.rlike("^[ACGT]{3}$")
        return F.when(codon == "---", "-").when(whole, F.substring(F.lit(AMINO_ACIDS), (a - 1) * 16 + (b - 1) * 4 + c, F.lit(1))).otherwise("X")

    return F.when(F.length(bases) > 0, F.array_join(F.transform(starts, amino), "")).otherwise(F.when(sequence.isNotNull(), ""))


def backtranslated(protein: Column, coding: Column) -> Column:
    """An aligned protein with its codons: three gaps for a gap; null where the coding text is not three letters for each amino acid."""
    letters = F.filter(F.split(protein, ""), lambda c: c != "")
    done = F.aggregate(
        letters,
        F.struct(F.lit("").alias("text"), F.lit(1).alias("at")),
        lambda s, c: F.struct(
            F.concat(s["text"], F.when(c == "-", "---").otherwise(F.substring(coding, s["at"], F.lit(3)))).alias("text"),
            (s["at"] + F.when(c == "-", 0).otherwise(3)).alias("at"),
        ),
    )
    return F.when(done["at"] == F.length(coding) + 1, done["text"])


def sample_id(primer: Column) -> Column:
    """The first run of lower-case letters, in upper case."""
    return F.upper(F.regexp_extract(primer, "[a-z]+", 0))


def umi_length(primer: Column) -> Column:
    """Length of the first run of N."""
    return F.length(F.regexp_extract(primer, "[Nn]+", 0))


def mean_error(quality: Column) -> Column:
    """Mean error probability of Phred+33 text; 1 for an empty one."""
    chars = F.filter(F.split(quality, ""), lambda c: c != "")
    total = F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.pow(F.lit(10.0), -F.greatest(F.ascii(c) - 33, F.lit(0)) / 10))
    return F.when(F.length(quality) > 0, total / F.length(quality)).otherwise(1.0)


def translated(sequence: Column) -> Column:
    """Amino acids of whole codons; X for a codon with any other letter than A, C, G, T (or U)."""
    bases = F.translate(F.upper(sequence), "U", "T")
    place = lambda i, k: F.position(F.substring(bases, i + k, F.lit(1)), F.lit(CODON_BASES))

    def amino(i: Column) -> Column:
        a, b, c = (place(i, k) for k in range(3))
        return F.when((a > 0) & (b > 0) & (c > 0), F.substring(F.lit(AMINO_ACIDS), (a - 1) * 16 + (b - 1) * 4 + c, F.lit(1))).otherwise("X")

    n = F.floor(F.length(bases) / 3).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i - 1) * 3 + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(starts, amino), "")


def kmers(sequence: Column, k: int) -> Column:
    """All k-mers of a text in order."""
    n = F.length(sequence) - (k - 1)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(sequence, i, F.lit(k)))


def mismatch_share(a: Column, b: Column) -> Column:
    """Share of mismatches among positions that are no gap in either of two aligned texts; 0 without any."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    both = F.filter(pairs, lambda p: (p["x"] != "-") & (p["y"] != "-") & (p["x"] != "") & (p["y"] != ""))
    return F.coalesce(F.try_divide(F.size(F.filter(both, lambda p: p["x"] != p["y"])).cast("double"), F.size(both).cast("double")), F.lit(0.0))


def jukes_cantor(share: Column) -> Column:
    """Jukes-Cantor distance of a mismatch share; null beyond its range."""
    return F.when(share < 0.75, -0.75 * F.log(1 - share * (4.0 / 3.0)))
