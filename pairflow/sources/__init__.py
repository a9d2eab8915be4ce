"""Where pairs come from and go to."""
