"""Connected components of a table of links, by alternating star contractions."""

from pyspark.sql import functions as F

from itemscope.session import written


def _large_star(links):
    """Each node's larger neighbours are linked to its smallest neighbour or itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
        .where("a > b").distinct()


def _small_star(links):
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return links.join(least, "a").select(
        F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                          F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l")) \
        .select("l.a", "l.b").where("a > b").distinct()


def components(links):
    """(node, root) of every node in a link, root being the smallest node of its component.

    `links` has columns a and b, long, in any order and repeated at will. Every round is written,
    so that a lost executor costs one round. The number of rounds grows with the logarithm of the
    longest path; the loop ends when a round changes nothing.
    """
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a > b").distinct(), "links")
    while True:
        stars = written(_small_star(_large_star(links)), "links")
        if stars.exceptAll(links).isEmpty() and links.exceptAll(stars).isEmpty():
            break
        links = stars
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
