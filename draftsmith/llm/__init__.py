"""Training-data operators over document, page and vector tables.

One module per operator; ``entries`` registers their queries.  Nothing outside
this package imports it (``__spark_entry__`` adds its queries only when the
package is present).
"""
