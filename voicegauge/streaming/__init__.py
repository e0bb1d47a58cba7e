"""Stream semantics: latest wins, text chunks, cumulative utterances, barge-in, endpoint sessions."""
