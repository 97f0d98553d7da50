"""Standard normal distribution as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Coefficients of Cody's rational approximations (1969) to the normal
# distribution function, lowest power first: |z| <= 0.67448975, up to sqrt(32), beyond.
CDF_CENTRE_TOP = [18154.981253343561249, 1067.6894854603709582, 161.02823106855587881, 2.2352520354606839287,
                  0.065682337918207449113]
CDF_CENTRE_BOTTOM = [45507.789335026729956, 10260.932208618978205, 976.09855173777669322, 47.20258190468824187, 1.0]
CDF_NEAR_TOP = [9842.7148383839780218, 11602.651437647350124, 6848.1904505362823326, 2494.5375852903726711,
                597.27027639480026226, 93.506656132177855979, 8.8831497943883759412, 0.39894151208813466764,
                1.0765576773720192317e-8]
CDF_NEAR_BOTTOM = [19685.429676859990727, 38912.003286093271411, 34900.952721145977266, 18615.571640885098091,
                   6485.558298266760755, 1519.377599407554805, 235.38790178262499861, 22.266688044328115691, 1.0]


def normal_cdf(z: Column) -> Column:
    """Phi(z), to about 1e-15; below 1e-8 in the tails to about 1e-9."""
    y, square = F.abs(z), z * z
    centre = F.lit(0.5) + z * _polynomial(CDF_CENTRE_TOP, square) / _polynomial(CDF_CENTRE_BOTTOM, square)
    tail = F.exp(-square / 2) * _polynomial(CDF_NEAR_TOP, y) / _polynomial(CDF_NEAR_BOTTOM, y)
    return F.when(y <= 0.67448975, centre).when(y > 38.0, F.when(z > 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        F.when(z > 0, 1 - tail).otherwise(tail))


# Coefficients of the published rational approximation AS 241
# (Wichura 1988) to the normal quantile, constant term first.
CENTRE_TOP = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
              1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
              3.3430575583588128105e4, 2.5090809287301226727e3]
CENTRE_BOTTOM = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
                 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
                 5.2264952788528545610e3]
NEAR_TOP = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
            3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
            2.27238449892691845833e-2, 7.74545014278341407640e-4]
NEAR_BOTTOM = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
               1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
               1.05075007164441684324e-9]
FAR_TOP = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
           2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
           2.71155556874348757815e-5, 2.01033439929228813265e-7]
FAR_BOTTOM = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
              7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
              2.04426310338993978564e-15]


def _polynomial(coefficients: list[float], x: Column) -> Column:
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(c)
    return total


def normal_quantile(p: Column) -> Column:
    """The inverse of Phi on (0, 1)."""
    q = p - F.lit(0.5)
    r = F.lit(0.180625) - q * q
    centre = q * _polynomial(CENTRE_TOP, r) / _polynomial(CENTRE_BOTTOM, r)
    t = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    near = _polynomial(NEAR_TOP, t - F.lit(1.6)) / _polynomial(NEAR_BOTTOM, t - F.lit(1.6))
    far = _polynomial(FAR_TOP, t - F.lit(5.0)) / _polynomial(FAR_BOTTOM, t - F.lit(5.0))
    return F.when(F.abs(q) <= 0.425, centre).otherwise(
        F.signum(q) * F.when(t <= 5.0, near).otherwise(far)
    )
