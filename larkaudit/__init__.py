"""Part of larkaudit."""
