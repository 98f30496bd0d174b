"""Ground-motion and geodetic analytics as DataFrame operators."""
