"""Tables that are brought up to date by what is new."""
