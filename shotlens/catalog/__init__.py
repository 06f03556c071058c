"""One driver query per operator on the test tables, each with an independent SQL twin."""
